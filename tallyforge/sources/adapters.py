"""The driver's tables in the shape of household records, and the same views as SQL.

orders are expenses, lineitem are incomes, region and nation the two category levels, supplier the suppliers and saving plans, part the products, recurring expenses and
projects. Column names are the records'. Each view selects few columns, so Parquet reads no others, and keeps the date column for range filters that reach the scan.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY

NOW = "1998-07-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share. Only a local session without one set gets it in /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix=f"spark-{label}-", dir="/tmp")
    return f"{root}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to a new shared folder and read from there: what follows computes it once, and a lost executor costs none of it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "planned").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "cancelled").otherwise("draft")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "necessary").when(F.col("o_orderpriority") == "3-MEDIUM", "voluntary").otherwise("toEvaluate")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").cast(MONEY).alias("amount"), F.to_date("o_orderdate").alias("expense_date"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("ym"), status.alias("status"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("notified"), kind.alias("classification"), "o_orderdate",
    )


def incomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "received").when(F.col("l_returnflag") == "A", "planned").when(F.col("l_linestatus") == "O", "skipped").otherwise("cancelled")
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 3 + 1).alias("contributor_id"), F.col("l_extendedprice").cast(MONEY).alias("amount"), F.to_date("l_shipdate").alias("income_date"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("ym"), status.alias("status"), "l_shipdate",
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.lit(1).alias("level"))
    sub = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name"), F.lit(2).alias("level"))
    return top.unionByName(sub)


def with_category(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Adds category_id; a customer of nation 24 has none that exists."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.when(F.col("c_nationkey") == 24, "n99").otherwise(F.concat(F.lit("n"), F.col("c_nationkey"))).alias("category_id"))
    return df.join(c, "customer_id", "left")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.lower("s_name"), F.replace("s_name", F.lit("#"), F.lit(" "))).alias("aliases"))


def saving_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.greatest(F.col("s_acctbal").cast(MONEY), F.lit(0).cast(MONEY)).alias("monthly_quota"), F.when(F.col("s_suppkey") % 5 == 0, "active").otherwise("paused").alias("status"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    start = F.add_months(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") / 50).cast("int") % 12)
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast(MONEY).alias("target_amount"), F.col("p_size").cast(MONEY).alias("saved_amount"), F.col("p_size").cast(MONEY).alias("monthly_quota"),
        start.alias("start_date"), (F.col("p_size") % 12 + 1).alias("remaining_months"), F.when(F.col("p_size") % 3 == 0, F.add_months(start, F.col("p_size"))).alias("target_date"), F.when(F.col("p_size") % 2 == 0, "active").otherwise("completed").alias("status"),
    )


def fixed_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind = F.col("p_partkey") / 10 % 7
    frequency = F.element_at(F.array(*map(F.lit, ["monthly", "bimonthly", "quarterly", "fourMonthly", "semiannual", "annual", "once"])), kind.cast("int") + 1)
    n = (F.col("p_partkey") / 10).cast("int")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").cast(MONEY).alias("expected_amount"), frequency.alias("frequency"), (F.col("p_size") % 32).alias("due_day"),
        (F.lit(1998 * 12 + 1) + n % 12).alias("start_ym"), (F.col("p_size") % 12 + 1).alias("duration_months"), F.when(F.col("p_size") % 4 != 0, "active").otherwise("suspended").alias("status"),
    )


#: The views in SQL, to stand at the head of a query.
SQL = {
    "expenses": """expenses AS (SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS expense_date,
  year(o_orderdate) * 12 + month(o_orderdate) AS ym,
  CASE WHEN o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' THEN 'planned' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'cancelled' ELSE 'draft' END AS status,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS notified,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'necessary' WHEN o_orderpriority = '3-MEDIUM' THEN 'voluntary' ELSE 'toEvaluate' END AS classification FROM orders)""",
    "incomes": """incomes AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey % 3 + 1 AS contributor_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS income_date,
  year(l_shipdate) * 12 + month(l_shipdate) AS ym,
  CASE WHEN l_returnflag = 'R' THEN 'received' WHEN l_returnflag = 'A' THEN 'planned' WHEN l_linestatus = 'O' THEN 'skipped' ELSE 'cancelled' END AS status FROM lineitem)""",
    "categories": """categories AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, 1 AS level FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 2 FROM nation)""",
    "category_of": "category_of AS (SELECT c_custkey AS customer_id, CASE WHEN c_nationkey = 24 THEN 'n99' ELSE 'n' || c_nationkey END AS category_id FROM customer)",
    "plans": "plans AS (SELECT s_suppkey AS id, greatest(CAST(s_acctbal AS DECIMAL(18,2)), 0) AS monthly_quota, CASE WHEN s_suppkey % 5 = 0 THEN 'active' ELSE 'paused' END AS status FROM supplier)",
    "projects": """projects AS (SELECT p_partkey AS id, p_name AS name, CAST(p_retailprice AS DECIMAL(18,2)) AS target_amount, CAST(p_size AS DECIMAL(18,2)) AS saved_amount, CAST(p_size AS DECIMAL(18,2)) AS monthly_quota,
  CAST(DATE '1998-01-01' + to_months(CAST(p_partkey // 50 % 12 AS INT)) AS DATE) AS start_date, p_size % 12 + 1 AS remaining_months,
  CASE WHEN p_size % 3 = 0 THEN CAST(DATE '1998-01-01' + to_months(CAST(p_partkey // 50 % 12 + p_size AS INT)) AS DATE) END AS target_date,
  CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'completed' END AS status FROM part)""",
    "fixed": """fixed AS (SELECT p_partkey AS id, p_name AS name, CAST(p_retailprice AS DECIMAL(18,2)) AS expected_amount,
  ['monthly', 'bimonthly', 'quarterly', 'fourMonthly', 'semiannual', 'annual', 'once'][CAST(p_partkey // 10 % 7 AS INT) + 1] AS frequency, p_size % 32 AS due_day,
  1998 * 12 + 1 + p_partkey // 10 % 12 AS start_ym, p_size % 12 + 1 AS duration_months, CASE WHEN p_size % 4 <> 0 THEN 'active' ELSE 'suspended' END AS status FROM part)""",
}


def sql(views: str, query: str) -> str:
    """A query over the named views."""
    return "WITH " + ",\n".join(SQL[v] for v in views.split()) + "\n" + query
