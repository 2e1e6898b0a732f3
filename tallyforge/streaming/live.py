"""Streaming forms of the batch operators: live totals, reminders without repeats, late facts that recompute their month.

A watermark bounds the state of live totals but never drops a late fact from the books: late facts go through `late_months`, which recomputes the months a micro-batch touches.
Sinks are written by month partition and micro-batch, so a batch that runs again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tallyforge.functions.money import MONEY
from tallyforge.operators.versions import Files


def events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event stream of a folder or glob of Parquet files. Event time is cast to timestamp: a watermark needs one."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Count and sum of each day and type."""
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", delay).groupBy(day, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast(MONEY)).alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def once(stream: DataFrame, keys: list[str], delay: str = "2 days") -> DataFrame:
    """The first event of each key: state is kept as long as a repeat may still come."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def run(df: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Append all that is there now, then stop; the result is a table under root. With output mode update it is the log of rows that changed.

    A micro-batch has a folder of its own, so one that runs again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    _finish(df.writeStream.foreachBatch(write).outputMode(mode), root)
    return df.sparkSession.read.schema(f"{ddl(df)}, batch long").parquet(f"{root}/rows").drop("batch")


def _finish(writer: DataStreamWriter, root: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upserted(df: DataFrame, root: str, keys: list[str], partition: str) -> StreamingQuery:
    """Keep a table of the latest row of each key: output mode update, so a micro-batch brings the keys that changed and the watermark lets go of the state of the others.

    Only the partitions of changed keys are merged. A partition has a folder for each micro-batch that touched it, holding all of its rows; the latest is the table (`latest`). A micro-batch
    that runs again starts from the folders before its number, so it replaces what it wrote. `vacuum` deletes folders that later ones replaced.
    """
    schema, rest = ddl(df), [c for c in df.columns if c not in keys]
    rows = f"{root}/rows"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = batch.select(F.col(partition).alias("_touched")).distinct()
        before = latest(spark, root, schema, partition, number).join(touched, F.col(partition).eqNullSafe(F.col("_touched")), "left_semi")
        both = before.select(*df.columns).withColumn("_n", F.lit(0)).unionByName(batch.select(*df.columns).withColumn("_n", F.lit(1)))
        same = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_n").alias("_row")).select(*keys, "_row.*")
        same.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition, "batch").parquet(rows)

    return _finish(df.writeStream.foreachBatch(write).outputMode("update"), root)


def latest(spark: SparkSession, root: str, schema: str, partition: str, below: int | None = None) -> DataFrame:
    """The table that upserted() keeps, or as it was before a micro-batch."""
    if not Files(spark, root).names(f"{root}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/rows")
    rows = rows if below is None else rows.where(F.col("batch") < below)
    last = rows.groupBy(F.col(partition).alias("_p")).agg(F.max("batch").alias("_b"))  # of partition columns alone
    return rows.join(last, F.col(partition).eqNullSafe(F.col("_p")) & (F.col("batch") == F.col("_b"))).select(*[f.name for f in rows.schema if f.name != "batch"])


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the latest `keep` folders of each partition, and tell how many went. One micro-batch may run again, so two stay."""
    files, gone = Files(spark, root), 0
    for part in files.names(f"{root}/rows"):
        if "=" in part:
            folders = sorted((n for n in files.names(f"{root}/rows/{part}") if n.startswith("batch=")), key=lambda n: int(n[6:]))
            for old in folders[:-keep]:
                files.delete(f"{root}/rows/{part}/{old}")
                gone += 1
    return gone


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def late_months(stream: DataFrame, facts_path: str, recompute: Callable[[DataFrame], DataFrame], reports_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch appends its facts (columns ym, ...) to facts_path by month and rewrites the reports of the months it touches, from all facts of those months."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("batch", F.lit(number))
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym", "batch").parquet(facts_path)
        touched = [r.ym for r in batch.select("ym").distinct().collect()]  # months, not facts
        if touched:
            recompute(spark.read.parquet(facts_path).where(F.col("ym").isin(touched))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ym").parquet(reports_path)

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
