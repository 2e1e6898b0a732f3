"""Parsed receipts into stored lines: a conditional merge that replaces unconfirmed lines and keeps confirmed ones, from batches that may come again.

A batch is applied to a store (versions.py) in one version together with its number, so a batch that is there already changes nothing: each is applied exactly once, whatever the stream repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators import receipts, versions
from tallyforge.sources.adapters import new_folder

#: Review states of lines that a new parse replaces, and what is said of a text without content.
UNCONFIRMED, EMPTY = ("pending", "rejected"), "rawText assente o vuoto"
TABLES = ("processes", "lines", "batches")
BATCHES = "number bigint"


def parsed(texts: DataFrame) -> DataFrame:
    """texts (process_id, text, further columns; together by process) with supplier, day and total of the receipt and its items (description, line_total, confidence) in place of the text."""
    item = lambda x: F.struct(x["description"].alias("description"), x["line_total"].alias("line_total"), x["confidence"].cast("int").alias("confidence"))
    rows = receipts.fields(texts, ["supplier", "date", "total", "items"], key=["process_id"])
    return rows.select(*[c for c in texts.columns if c != "text"], F.col("supplier.value").alias("supplier"), F.col("date.value").alias("day"), F.col("total.value").alias("total"), F.transform("items", item).alias("items"))


def merge(tables: dict[str, DataFrame], texts: DataFrame, number: int, folder: str | None = None) -> dict[str, DataFrame]:
    """The new state of TABLES after a batch of texts (process_id, text).

    processes: id, status, error, supplier, day, total, replaced, kept (lines of the last parse); lines: id, process_id, position, description, line_total, confidence, review_status; batches: number.
    Of several texts of a process the greatest counts; texts of unknown processes do nothing; a text without content marks its process as failed and leaves its lines.
    New lines have ids of process, batch and position, so no id comes twice, and are pending. Texts are brought together and parsed once, into `folder`; the new tables are made from there.
    """
    known = tables["processes"].select(F.col("id").alias("process_id")).hint("merge")  # ids compress well and look small: none of these sides is ever broadcast
    texts = texts.groupBy("process_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).join(known, "process_id", "left_semi")
    folder = folder or new_folder(tables["processes"].sparkSession, "parsed")
    once = parsed(texts.withColumn("empty", F.trim(F.regexp_replace("text", r"\s+", " ")) == ""))
    once.write.parquet(folder)
    once = once.sparkSession.read.schema(once.schema).parquet(folder)
    done = once.where(~F.col("empty")).drop("empty")
    # what goes and what stays of the lines that are there
    lines = tables["lines"].join(done.select("process_id", F.lit(True).alias("_again")).hint("merge"), "process_id", "left")
    goes = F.coalesce("_again", F.lit(False)) & F.col("review_status").isin(*UNCONFIRMED)
    counts = lines.where("_again").groupBy("process_id").agg(F.count_if(goes).alias("replaced"), F.count_if(~goes).alias("kept"))
    new = done.select("process_id", F.posexplode("items").alias("position", "x"))
    new = new.select(
        F.concat_ws("-", "process_id", F.lit(str(number)), F.col("position").cast("string")).alias("id"), "process_id", "position", F.col("x.description").alias("description"),
        F.col("x.line_total").cast(tables["lines"].schema["line_total"].dataType).alias("line_total"), F.col("x.confidence").alias("confidence"), F.lit("pending").alias("review_status"),
    )
    states = done.select("process_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"), "supplier", "day", "total").join(counts.hint("merge"), "process_id", "left")
    failed = once.where("empty").select("process_id", F.lit("failed").alias("status"), F.lit(EMPTY).alias("error"))
    now = states.unionByName(failed, allowMissingColumns=True)
    changed = F.struct(*[F.col(c) for c in now.columns if c != "process_id"])
    old = tables["processes"]
    p = old.join(now.select(F.col("process_id").alias("id"), changed.alias("_n")).hint("merge"), "id", "left")
    fresh = F.col("_n.status") == "completed"
    columns = {c: F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)) for c in ("status", "error")}
    columns |= {c: F.when(fresh, F.col(f"_n.{c}").cast(old.schema[c].dataType)).otherwise(F.col(c)) for c in ("supplier", "day", "total")}
    columns |= {c: F.when(fresh, F.coalesce(f"_n.{c}", F.lit(0))).otherwise(F.col(c)) for c in ("replaced", "kept")}
    kept = lines.where(~goes).select(*tables["lines"].columns)
    spark = old.sparkSession
    return {
        "processes": p.select(*[columns.get(c, F.col(c)).alias(c) for c in old.columns]), "lines": kept.unionByName(new),
        "batches": tables["batches"].unionByName(spark.range(1).select(F.lit(number).cast("bigint").alias("number"))),
    }


class _Applied(Exception):
    """The batch is in the store."""


def apply_batch(spark: SparkSession, root: str, texts: DataFrame, number: int) -> int | None:
    """Merge a batch into a store once: the new version, or None if the batch is there already."""

    folders: list[str] = []

    def change(snap: versions.Snapshot) -> dict[str, DataFrame]:
        if not snap.read("batches").where(F.col("number") == number).isEmpty():
            raise _Applied
        folders.append(new_folder(spark, "parsed"))
        return merge({t: snap.read(t) for t in TABLES}, texts, number, folders[-1])

    try:
        return versions.transact(spark, root, change)
    except _Applied:
        return None
    finally:
        for folder in folders:
            versions.Files(spark, folder).delete(folder)


def stream(texts: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of texts (process_id, text) into a store, all that is there now."""

    def write(batch: DataFrame, number: int) -> None:
        apply_batch(batch.sparkSession, root, batch, number)

    query = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
