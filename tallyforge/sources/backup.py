"""Backup and exchange files: tables as JSON lines with a header that carries a checksum, and the checks before they are read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import checksum
from tallyforge.operators import versions

FORMAT = "household-backup"


#: Timestamps keep their microseconds.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Broken(ValueError):
    """A backup that isn't what its header says."""


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row, fields in order of the schema and nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", **JSON}).alias("value"))


def row_checksums(df: DataFrame) -> DataFrame:
    """value and checksum of each row's JSON."""
    return as_json(df).select("value", checksum(F.col("value")).alias("checksum"))


#: Ways to sum up a text in a number: the checksum of the exchange format, which goes character by character, and a hash for large tables.
DIGESTS = {"text": lambda value: F.conv(checksum(value), 16, 10).cast("long"), "hash": lambda value: F.pmod(F.xxhash64(value), F.lit(1 << 31))}


def _summary(values: DataFrame, digest: str) -> list[Column]:
    return [F.count("*").alias("rows"), F.coalesce(F.sum(DIGESTS[digest](F.col("value"))), F.lit(0)).alias("checksum")]


def write(tables: dict[str, DataFrame], path: str, digest: str = "text") -> None:
    """Every table as a folder of compressed JSON lines, and a header row for each: name, rows, sum of row checksums (order of rows doesn't matter), schema."""
    header = None
    for name, df in tables.items():
        rows = as_json(df)
        rows.write.mode("overwrite").option("compression", "gzip").text(f"{path}/{name}")
        one = rows.agg(F.lit(name).alias("table"), *_summary(rows, digest)).withColumn("ddl", F.lit(", ".join(f"`{c}` {t}" for c, t in df.dtypes)))
        header = one if header is None else header.unionByName(one)
    header.withColumns({"format": F.lit(FORMAT), "digest": F.lit(digest)}).coalesce(1).write.mode("overwrite").json(f"{path}/_header_")


def _header(spark: SparkSession, path: str) -> DataFrame:
    kinds = "table string, rows long, checksum long, ddl string, format string, digest string"
    return spark.read.schema(kinds).json(f"{path}/_header_").where(F.col("format") == FORMAT)


def _agrees(spark: SparkSession, values: dict[str, DataFrame], path: str) -> DataFrame:
    """table, rows, ok: whether these JSON values are as many as the header says and sum up to the same."""
    header, found = _header(spark, path), None
    for r in header.select("table", "digest").collect():  # a row for each table
        one = values[r.table].agg(F.lit(r.table).alias("table"), *[c.alias(f"found_{n}") for c, n in zip(_summary(values[r.table], r.digest or "text"), ("rows", "checksum"), strict=True)])
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "table string, rows long, ok boolean")
    same = (F.col("rows") == F.col("found_rows")) & (F.col("checksum") == F.col("found_checksum"))
    return header.join(found, "table").select("table", "rows", F.coalesce(same, F.lit(False)).alias("ok"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Each table of a backup with what the header says against what is there."""
    return _agrees(spark, {r.table: spark.read.text(f"{path}/{r.table}") for r in _header(spark, path).select("table").collect()}, path)


def read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**JSON).json(f"{path}/{name}")


def restore(spark: SparkSession, path: str, root: str) -> int:
    """Replace a whole store by a backup, as one version; tables that the backup lacks go.

    The gate is before and behind the load: the files must agree with the header, and so must the typed rows that were loaded, written back as JSON (a value that its type can't hold
    would be lost without a word). If one table fails, the store stays as it was. Other writers' changes since then are replaced, as the backup is all there is to be.
    """
    kinds = {r.table: r.ddl for r in _header(spark, path).select("table", "ddl").collect()}
    if not kinds:
        raise Broken(f"{path}: no header")
    try:
        wrong = verify(spark, path).where("not ok").collect()
    except AnalysisException as error:
        raise Broken(f"{path}: a table is missing") from error
    if wrong:
        raise Broken(f"{path}: {', '.join(sorted(r.table for r in wrong))}")
    staged = versions.staged({name: read(spark, path, name, ddl) for name, ddl in kinds.items()}, root)
    wrong = _agrees(spark, {name: as_json(spark.read.parquet(p)) for name, p in staged.items()}, path).where("not ok").collect()
    if wrong:
        raise Broken(f"{path}: loaded rows of {', '.join(sorted(r.table for r in wrong))} differ")
    for _ in range(50):
        done = versions.commit(versions.snapshot(spark, root), staged, whole=True)
        if done:
            return done
    raise versions.Conflict(root)


def envelope(df: DataFrame, fmt: str, version: int) -> DataFrame:
    """Records as exchange envelopes: {format, version, payload}."""
    return df.select(F.to_json(F.struct(F.lit(fmt).alias("format"), F.lit(version).alias("version"), F.struct(*df.columns).alias("payload"))).alias("value"))


def open_envelopes(texts: DataFrame, fmt: str, version: int, payload: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, rejects) of envelope texts: rejects carry the reason."""
    parsed = texts.withColumn("e", F.from_json("value", f"struct<format:string,version:int,payload:struct<{payload}>>"))
    reason = F.when(F.col("e").isNull() | F.col("e.format").isNull(), "not an envelope").when(F.col("e.format") != fmt, "other format").when(F.col("e.version").isNull() | (F.col("e.version") > version), "newer version").when(F.col("e.payload").isNull(), "no payload")
    checked = parsed.withColumn("reason", reason)
    return checked.where("reason is null").select("e.payload.*"), checked.where("reason is not null").select("value", "reason")


def documents(spark: SparkSession, path: str, most_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """Image and PDF files up to a size, with a content hash; of equal files the first path stays."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes).where(F.lower("path").rlike(r"\.(jpe?g|png|webp|heic|pdf)$"))
    return files.withColumn("file_hash", F.sha2("content", 256)).groupBy("file_hash").agg(F.min_by(F.struct("path", "length", "modificationTime"), "path").alias("f")).select("file_hash", "f.*")
