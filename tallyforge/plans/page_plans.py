"""Registered queries of the report sink: pages are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import reports
from tallyforge.plans import budget_plans
from tallyforge.plans.screen_plans import _MONTH, _YEAR
from tallyforge.sources import adapters as A
from tallyforge.sources import pages

#: Lines of a printed page, and rows of a page of a listing.
LINES, ROWS = 40, 1000


def report_pages(spark: SparkSession, d: str) -> DataFrame:
    """The printed reports of all months as pages of LINES lines, read back from JSON."""
    months = budget_plans.monthly_budget_summary(spark, d).withColumn("ym", F.col("year") * 12 + F.col("month"))
    classes = budget_plans.classification_pivot(spark, d).withColumnRenamed("toevaluate", "to_evaluate").drop("total")
    none = {c: F.lit(None).cast("double") for c in ("opening", "used", "closing")}
    lines = reports.printed(months.join(classes, "ym", "left").withColumns({"status": F.when(F.col("ym") < budget_plans.END, "final"), **none}))
    root = A.new_folder(spark, "report")
    pages.write(lines, root, ["ym", "line"], LINES)
    return pages.read(spark, root, lines.schema)


def expense_pages(spark: SparkSession, d: str) -> DataFrame:
    """All expenses by date, the largest of a day first, as pages of ROWS rows, read back from CSV."""
    rows = A.expenses(spark, d).select("expense_date", (-F.col("amount")).alias("owed"), "id", "status")
    root = A.new_folder(spark, "report")
    pages.write(rows, root, ["expense_date", "owed", "id"], ROWS, "csv")
    return pages.read(spark, root, rows.schema, "csv")


def expense_page_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the manifest of expense_pages says of each page's size and place, and the pages that differ from it (none)."""
    rows = A.expenses(spark, d).select("expense_date", "id")
    root = A.new_folder(spark, "report")
    manifest = pages.write(rows, root, ["expense_date", "id"], ROWS)
    return manifest.join(pages.verify(spark, root, rows.schema), "page", "left").select("page", "n", "first", "last", "fault")


QUERIES = {f.__name__: f for f in (report_pages, expense_pages, expense_page_manifest)}

_AMOUNTS = {**{name: text for text, name in reports.PRINTED}, **{name: text for text, name in reports.PRINTED_CLASSES}}
_SOURCE = {"necessary": "c.necessary", "voluntary": "c.voluntary", "to_evaluate": "c.toevaluate"}


def _line(number: int, name: str, when: str = "TRUE") -> str:
    return f"SELECT ym, {number} AS k, '{_AMOUNTS[name]}' || CAST(CAST(coalesce({name}, 0) AS DECIMAL(18,2)) AS VARCHAR) AS text FROM m WHERE {when}"


_LINES = [_line(i + 4, name) for i, name in enumerate(("total_income", "paid_expenses", "notified_planned", "plan_quota", "project_quota", "prudential"))] + [
    _line(10, "deficit", "deficit > 0"), "SELECT ym, 11, 'Classificazione Spese:' FROM m", _line(12, "necessary"), _line(13, "voluntary"), _line(14, "to_evaluate"),
    "SELECT ym, 1, 'GESTIONE CASA' FROM m", f"SELECT ym, 2, 'Report Mensile Economico - ' || {_MONTH.format('ym')} || ' ' || {_YEAR.format('ym')} FROM m",
    f"SELECT ym, 3, 'Stato: ' || CASE WHEN ym < {budget_plans.END} THEN 'Definitivo' ELSE 'Provvisorio' END FROM m",
]
ORACLE_SQL = {
    "report_pages": f"""WITH b AS ({budget_plans.ORACLE_SQL["monthly_budget_summary"]}), c AS ({budget_plans.ORACLE_SQL["classification_pivot"]}),
m AS (SELECT b.year * 12 + b.month AS ym, b.*, c.necessary, c.voluntary, c.toevaluate AS to_evaluate FROM b LEFT JOIN c ON c.ym = b.year * 12 + b.month), t AS ({" UNION ALL ".join(_LINES)}),
p AS (SELECT *, row_number() OVER (ORDER BY ym, k) - 1 AS place FROM t)
SELECT CAST(ym AS INT) AS ym, CAST(row_number() OVER (PARTITION BY ym ORDER BY k) AS INT) AS line, text, place, place // {LINES} + 1 AS page FROM p""",
    "expense_pages": A.sql("expenses", f"""SELECT expense_date, -amount AS owed, id, status, place, place // {ROWS} + 1 AS page FROM (SELECT *, row_number() OVER (ORDER BY expense_date, -amount, id) - 1 AS place FROM expenses)"""),
    "expense_page_manifest": f"""WITH c AS (SELECT count(*) AS n FROM orders), p AS (SELECT n, unnest(range(0, n, {ROWS})) AS first FROM c)
SELECT first // {ROWS} + 1 AS page, least({ROWS}, n - first) AS n, first, least(first + {ROWS}, n) - 1 AS last, CAST(NULL AS VARCHAR) AS fault FROM p""",
}
