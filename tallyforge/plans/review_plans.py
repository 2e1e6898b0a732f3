"""Registered queries: labels, reviews of parsed lines, form checks, slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import labels
from tallyforge.operators import review
from tallyforge.sources import adapters as A

WORDS = ["stipendio 1", " Pensione ", "RENDITA", "bonus", "gift", "", "xyz", "rimborso"]


def _pick(index, words: list[str]):  # noqa: ANN001, ANN202
    return F.element_at(F.array(*map(F.lit, words)), (index % len(words)).cast("int") + 1)


def income_types(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem")
    key = labels.income_type(_pick(F.col("l_partkey"), WORDS), _pick(F.col("l_suppkey"), ["Pensione", "", "altro"]))
    return li.groupBy(key.alias("income_type"), labels.income_type_label(key).alias("label")).agg(F.count("*").alias("n"))


def home_addresses(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "customer")
    n = F.col("c_custkey")
    return c.select(n.alias("id"), labels.home_address(F.when(n % 3 != 0, F.lit(" Via Roma ")), F.when(n % 2 == 0, n.cast("string")), F.when(n % 5 != 0, F.lit("20100"))).alias("address"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem")
    k = F.col("l_partkey")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_index"), (F.col("l_quantity") - 3).alias("quantity"), F.when(k % 6 == 0, F.lit(0.0)).otherwise((k % 400) / 4).alias("unit_price"),
        F.when(k % 9 == 0, F.lit(0.0)).when(k % 10 == 0, F.lit(-2.5)).otherwise((k % 1000) / 8).alias("line_total"), F.when(k % 4 == 0, F.lit(None)).when(k % 7 == 0, review.UNCLASSIFIED).otherwise("cat").alias("category_id"),
        _pick(k, ["PANE", "SCONTO SOCI", "RESO VUOTO", " ", "LATTE"]).alias("description"), F.when(k % 8 == 0, "modified").otherwise("pending").alias("status"), (k % 11 == 0).alias("conflict"), F.when(k % 13 == 0, F.array(F.lit("DISCOUNT_LINE"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def review_line_groups(spark: SparkSession, d: str) -> DataFrame:
    flags = ["is_error", "is_unclassified", "is_modified", "is_discount", "is_return"]
    return review.line_groups(_lines(spark, d)).groupBy(*flags).agg(F.count("*").alias("n"))


def review_line_sum(spark: SparkSession, d: str) -> DataFrame:
    return review.line_sum(_lines(spark, d), "document_id")


def review_errors(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select(F.explode(F.transform(review.line_errors(), lambda m: F.regexp_replace(m, '^"[^"]*"|^Riga #[0-9]+', "*"))).alias("message")).groupBy("message").agg(F.count("*").alias("n"))


def line_edits(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    edits = lines.where("document_id % 4 = 0").select("id", F.when(F.col("line_index") % 2 == 0, F.lit(2.0)).alias("quantity"), F.when(F.col("line_index") % 3 == 0, F.lit(1.25)).alias("unit_price")).dropDuplicates(["id"])
    return review.edit(lines, edits, "id").groupBy("document_id").agg(F.sum(F.col("line_total").cast("decimal(18,3)")).cast("double").alias("total"), F.count_if(F.col("status") == "modified").alias("modified"))


def form_errors(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders")
    n = F.col("o_orderkey")
    rows = o.select(
        F.when(n % 5 == 0, " ").otherwise("c1").alias("contributor_id"), F.when(n % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("amount"), F.when(n % 11 != 0, F.to_date("o_orderdate")).alias("date"), F.when(n % 3 == 0, "").otherwise("Spesa").alias("description"),
        F.when(n % 13 != 0, "cat").alias("category_id"), F.when(n % 17 != 0, "sub").alias("subcategory_id"),
    )
    return rows.groupBy(review.income_error().alias("income_error"), review.expense_error().alias("expense_error")).agg(F.count("*").alias("n"))


def project_slots(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part").where("p_partkey in (5, 8, 11)").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") == 11, 1).otherwise(9).alias("slot"))
    return review.project_slots(p)


def visible_contributors(spark: SparkSession, d: str) -> DataFrame:
    s = A.read(spark, d, "supplier")
    n = F.col("s_suppkey")
    people = s.select(n.alias("id"), (n + 1).cast("int").alias("order"), (n % 3 == 0).alias("active"), _pick(n, ["Contributore 2", "Maria", "secondo contributore", ""]).alias("name"), _pick(n, ["", "a@example.com", "m@casa.it"]).alias("email"), (n % 8 == 5).alias("notified"))
    used = A.read(spark, d, "lineitem").where("l_suppkey % 6 = 4").select(F.col("l_suppkey").alias("contributor_id"))
    return review.visible_contributors(people, used).select("id", "order", "name")


_LINES = """l AS (SELECT l_orderkey AS document_id, l_linenumber AS line_index, l_quantity - 3 AS quantity, CASE WHEN l_partkey % 6 = 0 THEN 0.0 ELSE l_partkey % 400 / 4.0 END AS unit_price, CASE WHEN l_partkey % 9 = 0 THEN 0.0 WHEN l_partkey % 10 = 0 THEN -2.5 ELSE l_partkey % 1000 / 8.0 END AS line_total,
  l_partkey % 4 = 0 OR l_partkey % 7 = 0 AS uncat, ['PANE', 'SCONTO SOCI', 'RESO VUOTO', ' ', 'LATTE'][CAST(l_partkey % 5 AS INT) + 1] AS description, CASE WHEN l_partkey % 8 = 0 THEN 'modified' ELSE 'pending' END AS status, l_partkey % 11 = 0 AS conflict, l_partkey % 13 = 0 AS warned FROM lineitem)"""
_WORD = "list_extract(['stipendio 1', 'pensione', 'rendita', 'bonus', 'gift', '', 'xyz', 'rimborso'], CAST(l_partkey % 8 AS INT) + 1)"

QUERIES = {f.__name__: f for f in (income_types, home_addresses, review_line_groups, review_line_sum, review_errors, line_edits, form_errors, project_slots, visible_contributors)}
ORACLE_SQL = {
    "income_types": f"""WITH w AS (SELECT {_WORD} AS w, l_suppkey % 3 AS s FROM lineitem), k AS (SELECT CASE w WHEN 'stipendio 1' THEN 'salary' WHEN 'pensione' THEN 'pension' WHEN 'rendita' THEN 'income' WHEN 'bonus' THEN 'extraordinary_contribution' WHEN 'rimborso' THEN 'refund'
  WHEN '' THEN CASE s WHEN 0 THEN 'pension' WHEN 2 THEN 'other' ELSE 'salary' END ELSE 'other' END AS income_type FROM w)
SELECT income_type, CASE income_type WHEN 'salary' THEN 'Stipendio' WHEN 'pension' THEN 'Pensione' WHEN 'income' THEN 'Reddito' WHEN 'refund' THEN 'Rimborso' WHEN 'extraordinary_contribution' THEN 'Contributo straordinario' ELSE 'Altro' END AS label, count(*) AS n FROM k GROUP BY 1, 2""",
    "home_addresses": "SELECT c_custkey AS id, nullif(concat_ws(' – ', nullif(concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN 'Via Roma' END, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END), ''), CASE WHEN c_custkey % 5 <> 0 THEN '20100' END), '') AS address FROM customer",
    "review_line_groups": f"""WITH {_LINES} SELECT uncat OR quantity <= 0 OR (unit_price <= 0 AND line_total = 0) OR conflict OR warned AS is_error, uncat AS is_unclassified, status = 'modified' AS is_modified, line_total < 0 OR description = 'SCONTO SOCI' OR warned AS is_discount, line_total < 0 OR description = 'RESO VUOTO' AS is_return, count(*) AS n FROM l GROUP BY 1, 2, 3, 4, 5""",
    "review_line_sum": f"WITH {_LINES} SELECT document_id, floor(CAST(sum(CAST(CASE WHEN line_total > 0 THEN line_total ELSE quantity * unit_price END AS DECIMAL(24,4))) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS line_sum FROM l GROUP BY 1",
    "review_errors": f"""WITH {_LINES}, m AS (SELECT '*: descrizione articolo mancante.' AS message FROM l WHERE trim(description) = '' UNION ALL SELECT '*: categoria mancante. Seleziona una categoria valida prima di confermare.' FROM l WHERE uncat UNION ALL SELECT '*: quantità non valida.' FROM l WHERE quantity <= 0
  UNION ALL SELECT '*: importo riga non valido (prezzo unitario e totale <= 0).' FROM l WHERE NOT (line_total < 0 OR description IN ('SCONTO SOCI', 'RESO VUOTO')) AND unit_price <= 0 AND line_total <= 0) SELECT message, count(*) AS n FROM m GROUP BY 1""",
    "line_edits": f"""WITH {_LINES}, e AS (SELECT *, document_id % 4 = 0 AND (line_index % 2 = 0 OR line_index % 3 = 0) AS t, CASE WHEN line_index % 2 = 0 THEN 2.0 ELSE quantity END AS q, CASE WHEN line_index % 3 = 0 THEN 1.25 ELSE unit_price END AS p FROM l)
SELECT document_id, CAST(sum(CAST(CASE WHEN t THEN floor(q * p * 100.0 + 0.5) / 100.0 ELSE line_total END AS DECIMAL(18,3))) AS DOUBLE) AS total, count(*) FILTER (WHERE t OR status = 'modified') AS modified FROM e GROUP BY 1""",
    "form_errors": """WITH n AS (SELECT o_orderkey AS n FROM orders) SELECT CASE WHEN n % 5 = 0 THEN 'Seleziona un contributore.' WHEN n % 7 = 0 THEN 'Inserisci un importo valido e maggiore di zero.' WHEN n % 11 = 0 THEN 'Inserisci una data di incasso valida.' END AS income_error,
  CASE WHEN n % 3 = 0 THEN 'Inserisci una descrizione per la spesa.' WHEN n % 7 = 0 THEN 'Inserisci un importo valido e maggiore di zero.' WHEN n % 11 = 0 THEN 'Inserisci una data spesa valida.' WHEN n % 13 = 0 THEN 'Seleziona una categoria principale.' WHEN n % 17 = 0 THEN 'Seleziona una sottocategoria.' END AS expense_error, count(*) AS n FROM n GROUP BY 1, 2""",
    "project_slots": "SELECT * FROM (VALUES (1, 11::BIGINT), (2, 8::BIGINT), (3, 11::BIGINT)) AS v(slot, project_id)",
    "visible_contributors": """WITH s AS (SELECT s_suppkey AS n FROM supplier), u AS (SELECT DISTINCT l_suppkey AS n FROM lineitem WHERE l_suppkey % 6 = 4),
k AS (SELECT n, ['Contributore 2', 'Maria', 'secondo contributore', ''][CAST(n % 4 AS INT) + 1] AS name FROM s WHERE NOT (n <> 0 AND n % 3 <> 0 AND n NOT IN (SELECT n FROM u) AND n % 4 <> 1 AND n % 3 <> 2 AND n % 8 <> 5))
SELECT n AS id, CAST(row_number() OVER (ORDER BY n) AS INT) AS order, name FROM k""",
}
