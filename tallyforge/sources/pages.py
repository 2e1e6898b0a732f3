"""Report sink: rows in reading order, cut into pages of a fixed number of rows, with a manifest of the pages.

Rows are dealt out in ranges of the order and sorted there; each range's row count gives the place where the next begins, so no task sees more than a range and no row passes through the driver. Equal
rows, which may be a third of all, are told apart by their place in a saved copy, so they spread over ranges as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyforge.sources.adapters import saved

MANIFEST = "page bigint, n bigint, first bigint, last bigint, digest string"
FORMATS = ("json", "csv")
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CSV = {**JSON, "header": "true", "escape": '"', "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt out in ranges of `order` and sorted there, with `_at`: the number of the range in the upper 31 bits, the place in it in the lower 33."""
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    kept = saved(df.withColumns({"_content": content, "_id": F.monotonically_increasing_id()}), "pages")
    return saved(kept.repartitionByRange(*order, "_content", "_id").sortWithinPartitions(*order, "_content", "_id").drop("_content", "_id").withColumn("_at", F.monotonically_increasing_id()), "pages")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `place`: its place in `order`, from 0 and without gaps. Ties stand in the order of their content's hash; nulls come first."""
    ranked = ranges(df, order)
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range: as many as there are shuffle partitions
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    return ranked.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + within).drop("_at", "_part", "_start")


def _digest(columns: list[str]) -> list:
    row = F.xxhash64(F.col("place"), *[F.col(c).cast("string") for c in columns])
    return [F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.lower(F.hex(F.bit_xor(row))).alias("digest")]


def write(df: DataFrame, root: str, order: list[str], rows: int = 1000, kind: str = "json") -> DataFrame:
    """Write df under root/pages as one file a page of `rows` rows, its rows in order with their `place`, and root/manifest; the manifest is returned.

    df must not have columns `page` or `place` of its own. An empty table has an empty manifest and no pages. In CSV null is written as \\N,
    so that it isn't empty text. What was written is read again and compared: rows that a format can't hold (a text of \\N in CSV) raise an error.
    """
    clash = {"page", "place", "_content", "_id", "_at", "_part", "_start"} & {c.lower() for c in df.columns}
    if kind not in FORMATS or rows < 1 or clash:
        raise ValueError(f"can't write pages: kind {kind!r}, rows {rows}, reserved columns {sorted(clash)}")
    paged = numbered(df, order).withColumn("page", F.floor(F.col("place") / rows) + 1)
    out = paged.repartitionByRange("page").sortWithinPartitions("page", "place").write.partitionBy("page")
    options = {**CSV, "quoteAll": "true"} if kind == "csv" else {**JSON, "ignoreNullFields": "false"}
    out.options(**options).format(kind).save(f"{root}/pages")
    manifest = read(df.sparkSession, root, df.schema, kind).groupBy("page").agg(*_digest(df.columns))
    expected = saved(paged.groupBy("page").agg(*_digest(df.columns)), "pages")
    expected.coalesce(1).write.json(f"{root}/manifest")  # a row a page
    if manifest.exceptAll(expected).unionByName(expected.exceptAll(manifest)).limit(1).count():
        raise RuntimeError(f"the pages under {root} aren't the rows that were written")
    return expected


def read(spark: SparkSession, root: str, schema: StructType | str, kind: str = "json") -> DataFrame:
    """The rows of all pages with `page` and `place`. schema: that of the rows."""
    rows = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.schema(StructType([*rows, StructField("place", LongType()), StructField("page", LongType())]))
    options = {**CSV, "multiLine": "true"} if kind == "csv" else JSON
    return reader.options(**options).format(kind).load(f"{root}/pages")


def verify(spark: SparkSession, root: str, schema: StructType | str, kind: str = "json") -> DataFrame:
    """Pages that are missing, foreign or other than the manifest says."""
    columns = [f.name for f in read(spark, root, schema, kind).schema if f.name not in ("page", "place")]
    found = read(spark, root, schema, kind).groupBy("page").agg(*_digest(columns))
    told = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    same = F.struct("n", "first", "last", "digest")
    both = told.select("page", same.alias("told")).join(found.select("page", same.alias("found")), "page", "full")
    return both.where(~F.col("told").eqNullSafe(F.col("found"))).select("page", F.when(F.col("found").isNull(), "missing").when(F.col("told").isNull(), "foreign").otherwise("changed").alias("fault"))
