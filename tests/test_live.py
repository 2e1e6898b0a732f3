"""Live totals: update mode with an upsert sink, bounded state, and a micro-batch that runs again."""

import datetime as dt

from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY
from tallyforge.streaming import live

DDL = "day date, event_type string, n bigint, total decimal(28,2)"


def days(spark, src, numbers):
    for n in numbers:  # a file a day, with a row for the day before
        rows = [(dt.datetime(2024, 1, 1, 9) + dt.timedelta(n), "a", 1.25), (dt.datetime(2024, 1, 1, 10) + dt.timedelta(n), "b", 2.5), (dt.datetime(2024, 1, 1, 23) + dt.timedelta(n - 1), "a", 4.0)]
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(src)


def table(spark, root):
    return {(r.day, r.event_type): (r.n, float(r.total)) for r in live.latest(spark, root, DDL, "day").collect()}


def test_totals_are_updated_and_state_is_let_go(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/out"
    days(spark, src, range(12))
    stream = live.daily_totals(live.events(spark, src, 1), "1 day")
    assert live.ddl(stream).replace("`", "") == DDL
    query = live.upserted(stream, root, ["day", "event_type"], "day")
    sizes = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    assert len(sizes) >= 12 and max(sizes) == max(sizes[:4])  # two keys a day, a day and a half of delay: no growth after that
    first = table(spark, root)
    facts = spark.read.parquet(src).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast(MONEY)).alias("total"))
    assert first == {(r.day, r.event_type): (r.n, float(r.total)) for r in facts.collect()}
    days(spark, src, [12])  # the stream goes on where it was
    live.upserted(stream, root, ["day", "event_type"], "day")
    assert table(spark, root)[(dt.date(2024, 1, 12), "a")] == (2, 5.25) and len(table(spark, root)) == len(first) + 2
    assert live.vacuum(spark, root, 1) > 0 and live.vacuum(spark, root, 1) == 0
    assert len(table(spark, root)) == len(first) + 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    frame = lambda rows: spark.createDataFrame([(dt.date(2024, 1, d), k, n, n) for d, k, n in rows], "day date, event_type string, n bigint, total int").withColumn("total", F.col("total").cast("decimal(28,2)"))
    sink = {}

    class Writer:
        """Takes the function of foreachBatch instead of a stream's."""

        def foreachBatch(self, f):  # noqa: N802
            sink["write"] = f
            return self

        def __getattr__(self, name):
            return lambda *a, **k: self

    class Stream:
        columns, dtypes, writeStream = ["day", "event_type", "n", "total"], [("day", "date"), ("event_type", "string"), ("n", "bigint"), ("total", "decimal(28,2)")], Writer()

    live.upserted(Stream(), root, ["day", "event_type"], "day")
    write = sink["write"]
    write(frame([(1, "a", 1), (1, "b", 2), (2, "a", 3)]), 0)
    write(frame([(1, "a", 5)]), 1)
    once = table(spark, root)
    assert once == {(dt.date(2024, 1, 1), "a"): (5, 5.0), (dt.date(2024, 1, 1), "b"): (2, 2.0), (dt.date(2024, 1, 2), "a"): (3, 3.0)}
    write(frame([(1, "a", 5)]), 1)
    assert table(spark, root) == once
    for _ in range(2):
        write(frame([(1, "a", 6), (3, None, 1)]), 2)
    write(frame([(3, None, 4)]), 3)
    assert table(spark, root) == once | {(dt.date(2024, 1, 1), "a"): (6, 6.0), (dt.date(2024, 1, 3), None): (4, 4.0)}
    assert live.latest(spark, root, DDL, "day").count() == 4
