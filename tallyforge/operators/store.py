"""Record-store operations on whole tables: upserts, reconciliation, cascades and constraints.

Parquet has no transactions, so a change is computed as the new state of a table; `publish` writes several tables to staged folders and names them in the next manifest of the store
(versions.py), which is what makes a change of many tables all or nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators import versions


def last_write(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by natural key: of all rows of a key the last in `order` stays. max_by needs one shuffle with partial aggregation, where row_number() would sort every group."""
    rest = [c for c in base.columns if c not in keys]
    every = base.unionByName(changes)
    picked = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*base.columns)


def patch(base: DataFrame, patches: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Overlay non-null fields of patches (one row for each key) on base; a patched row's version goes up by one."""
    fields = [c for c in patches.columns if c != key]
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    out = base.join(p, key, "left")
    columns = [F.coalesce(f"_{c}", c).alias(c) if c in fields else (F.col(c) + F.coalesce(F.col("_hit").cast("int"), F.lit(0))).alias(c) if c == version else F.col(c) for c in base.columns]
    return out.select(*columns)


def mark(base: DataFrame, marks: DataFrame, key: str, column: str, order: list[str], first: list[str] | None = None) -> DataFrame:
    """base with `column` set by the last mark of each key (marks: key, column, order); marks of other keys do nothing, see `unknown`. Marks are reduced in each task before they meet base.

    first: of marks that are equal in `order` the first by these columns counts; without them any does.
    """
    if first:
        marks = marks.groupBy(key, *order).agg(F.min_by(F.struct(column), F.struct(*first)).alias("_r")).select(key, *order, f"_r.{column}")
    last = marks.groupBy(key).agg(F.max_by(F.struct(F.col(column).alias("_mark")), F.struct(*order)).alias("_last"))
    return base.join(last, key, "left").withColumn(column, F.when(F.col("_last").isNotNull(), F.col("_last._mark")).otherwise(F.col(column))).select(*base.columns)


def unknown(base: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Keys of marks that base doesn't have."""
    return marks.select(key).distinct().join(base, key, "left_anti")


def set_reconcile(stored: DataFrame, wanted: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """What a full replacement does to each key: insert, update, delete or keep."""
    s = stored.select(key, F.struct(*compare).alias("_s"))
    w = wanted.select(key, F.struct(*compare).alias("_w"))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_w").isNull(), "delete").when(F.col("_s") == F.col("_w"), "keep").otherwise("update")
    return s.join(w, key, "full").select(key, action.alias("action"))


def without(df: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Cascade: rows whose `column` is among the keys that go."""
    return df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def set_null(df: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Set-null: rows stay and their reference to a key that goes becomes null."""
    g = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return df.join(g, column, "left").withColumn(column, F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(column))).select(*df.columns)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def beyond(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """Rows beyond the first `most` of their group: they go to quarantine."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") > most).drop("_n")


def reindex(df: DataFrame, group: str, order: list[str], to: str) -> DataFrame:
    """Contiguous numbers from 0 within each group."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def reorder(df: DataFrame, wanted: DataFrame, group: str, key: str, to: str) -> DataFrame:
    """Explicit order: each listed row takes its place in its group's list, the last one if it is listed twice. Unlisted rows keep their number; entries of other groups do nothing.

    wanted: group, key, position. One join on the key, whatever the size of a group.
    """
    places = wanted.groupBy(group, key).agg(F.max("position").alias("_place"))
    return df.join(places, [group, key], "left").withColumn(to, F.coalesce("_place", to)).select(*df.columns)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def defaulted(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The one settings row, or the defaults if there is none."""
    spark: SparkSession = df.sparkSession
    return spark.range(1).select(F.lit(True).alias("_on")).join(df.withColumn("_on", F.lit(True)), "_on", "left").select(*[F.coalesce(F.col(c), d).alias(c) if c in df.columns else d.alias(c) for c, d in defaults.items()])


def defaulted_each(owners: DataFrame, stored: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """The settings of each owner: the stored row (one for each key), a default for each field that it lacks or leaves empty."""
    s = stored.select(key, *[F.col(c).alias(f"_{c}") for c in defaults if c in stored.columns])
    return owners.select(key).join(s, key, "left").select(key, *[F.coalesce(f"_{c}", d).alias(c) if c in stored.columns else d.alias(c) for c, d in defaults.items()])


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """Replace these tables of a store by one new version; other tables stay as the latest version has them. Returns the version."""
    return versions.transact(next(iter(tables.values())).sparkSession, root, lambda _: tables)


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the latest version."""
    return versions.snapshot(spark, root).read(name)
