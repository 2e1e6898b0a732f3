"""Registered queries that run a stream to its end and return the table it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY
from tallyforge.operators import parsing, store, versions
from tallyforge.plans.receipt_plans import _ITEMS, rendered
from tallyforge.sources.adapters import new_folder, read
from tallyforge.streaming import live


def _source(spark: SparkSession, d: str) -> DataFrame:
    return live.events(spark, f"{d}/events*.parquet")


def stream_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    root, totals = new_folder(spark, "stream"), live.daily_totals(_source(spark, d))
    live.upserted(totals, root, ["day", "event_type"], "day")
    return live.latest(spark, root, live.ddl(totals), "day").select("day", "event_type", "n", F.col("total").cast("double"))


def stream_dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    keyed = _source(spark, d).withColumn("key", F.concat_ws("_", "user_id", "event_type"))
    return live.run(live.once(keyed, ["key"], "60 days").select("key"), new_folder(spark, "stream"))


def stream_late_recompute(spark: SparkSession, d: str) -> DataFrame:
    root = new_folder(spark, "stream")
    facts = _source(spark, d).select((F.year("ts") * 12 + F.month("ts")).alias("ym"), "event_type", F.col("value").cast(MONEY).alias("amount"))
    live.late_months(facts, f"{root}/facts", lambda f: f.groupBy("ym", "event_type").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total")), f"{root}/reports", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/reports")


def _stored_receipts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A process for each order and a stored line for each of its lines, some of which are confirmed."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    processes = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("pending").alias("status"), *none("string", "error", "supplier", "day"), *none("double", "total"), *none("bigint", "replaced", "kept"))
    review = F.when(F.col("l_returnflag") == "R", "confirmed").when(F.col("l_returnflag") == "A", "rejected").otherwise("pending")
    n, k = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("int")
    lines = li.select(F.concat_ws("-", F.lit("old"), n, k.cast("string")).alias("id"), n.alias("process_id"), k.alias("position"), F.lit("old").alias("description"), F.lit(0).cast("decimal(18,2)").alias("line_total"), F.lit(1).alias("confidence"), review.alias("review_status"))
    return {"processes": processes, "lines": lines, "batches": spark.createDataFrame([], parsing.BATCHES)}


def stream_persist_parse(spark: SparkSession, d: str) -> DataFrame:
    """Texts of two thirds of the orders (every tenth text is empty) are parsed from a stream into stored lines, and its batch comes again. Each receipt and its lines afterwards."""
    root, n = new_folder(spark, "stream"), F.col("order_id")
    store.publish(_stored_receipts(spark, d), f"{root}/store")
    texts = rendered(spark, d).where("order_id % 3 <> 0").select(n.cast("string").alias("process_id"), F.when(n % 10 == 1, " \n").otherwise(F.col("text")).alias("text"))
    texts.write.parquet(f"{root}/texts")
    for checkpoint in ("one", "two"):  # a lost checkpoint: the stream begins anew with batch 0
        parsing.stream(spark.readStream.schema("process_id string, text string").parquet(f"{root}/texts"), f"{root}/store", f"{root}/{checkpoint}")
    now = versions.snapshot(spark, f"{root}/store")
    lines = now.read("lines").groupBy(F.col("process_id").alias("id")).agg(F.count_if(F.col("description") == "old").alias("old_lines"), F.count_if(F.col("description") != "old").alias("new_lines"), F.sum("line_total").cast("double").alias("line_sum"))
    shown = now.read("processes").select("id", "status", "error", "supplier", "total", "replaced", "kept").join(lines.hint("merge"), "id", "left")
    return shown.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("old_lines", "new_lines")})


QUERIES = {f.__name__: f for f in (stream_daily_totals, stream_dedupe_keys, stream_late_recompute, stream_persist_parse)}
ORACLE_SQL = {
    "stream_persist_parse": f"""WITH {_ITEMS}, g AS (SELECT l_orderkey AS o, CAST(count(*) AS BIGINT) AS n, CAST(sum(c - off) AS DOUBLE) / 100.0 AS total FROM it GROUP BY 1),
s AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS confirmed FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey AS o, o_custkey, CASE WHEN g.o IS NULL OR o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 10 = 1 THEN 'failed' ELSE 'completed' END AS status FROM orders LEFT JOIN g ON g.o = o_orderkey)
SELECT CAST(p.o AS VARCHAR) AS id, status, CASE WHEN status = 'failed' THEN 'rawText assente o vuoto' END AS error, CASE WHEN status = 'completed' THEN 'MERCATO ' || o_custkey || ' S.R.L.' END AS supplier,
  CASE WHEN status = 'completed' THEN total END AS total, CASE WHEN status = 'completed' THEN s.n - confirmed END AS replaced, CASE WHEN status = 'completed' THEN confirmed END AS kept,
  coalesce(CASE WHEN status = 'completed' THEN confirmed ELSE s.n END, 0) AS old_lines, CASE WHEN status = 'completed' THEN g.n ELSE 0 END AS new_lines,
  CASE WHEN status = 'completed' THEN total WHEN s.n IS NOT NULL THEN 0.0 END AS line_sum FROM p LEFT JOIN g USING (o) LEFT JOIN s USING (o)""",
    "stream_daily_totals": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "stream_dedupe_keys": "SELECT DISTINCT user_id || '_' || event_type AS key FROM events",
    "stream_late_recompute": "SELECT CAST(year(ts) * 12 + month(ts) AS INT) AS ym, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
}
