"""Shared helpers of the text operators: table access, shared scratch tables, text batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract: space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]"


#: Rows that travel to Python at once. The session's default would hold tens of MB of text for each task, in the JVM and in Python.
ROWS_AT_ONCE = 500


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))


def release() -> None:
    """Give memory that a worker no longer uses back to the system; workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session without one (a local test) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when the driver collects the garbage that names them, which a large heap puts off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        lean(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that save() returned and that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(number: Column | str, modulus: int) -> Column:
    """crc32 of an id as text, modulo: the fixed split into folds."""
    return F.crc32(F.col(number).cast("string").cast("binary") if isinstance(number, str) else number.cast("string").cast("binary")) % modulus


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut so that their texts hold about `limit` bytes at most (a longer text comes alone); a null text is empty. The column holds strings or bytes."""
    try:
        for batch in batches:
            column = batch.column(text)
            empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            start = held = 0
            for i, n in enumerate(sizes):
                if i > start and held + n > limit:
                    part = batch.slice(start, i - start)
                    yield part, [t or empty for t in part.column(text).to_pylist()]
                    start, held = i, 0
                held += n
            if start < batch.num_rows:
                part = batch.slice(start)
                yield part, [t or empty for t in part.column(text).to_pylist()]
    finally:
        release()


def with_totals(rows: DataFrame, keys: list[str], scratch: Scratch, where: str | None = None, **totals: Column) -> DataFrame:
    """rows (saved ones, as they are read twice) with aggregates of their group, name=aggregate; where: a condition on these that groups must meet.

    The aggregation combines in each task before it shuffles, so a group sends one row from each. Its result is saved: then the join has a plain shuffle on both sides, with one row for
    each key on one of them, and Spark's adaptive skew join cuts a hot key of rows into several tasks.
    """
    whole = rows.groupBy(*keys).agg(*[column.alias(name) for name, column in totals.items()])
    return rows.join(scratch.save(whole.where(where) if where else whole, "totals"), keys)
