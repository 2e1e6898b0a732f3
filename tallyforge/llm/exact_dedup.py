"""Exact dedup (operator 2), DataFrame functions only.

Rows group by the 128-bit hash of their normalised text. Whether a hash ever stands for two different texts is decided by the bytes: one aggregation keyed by
(hash, text) counts the texts behind each hash, and a hash with several is split by text. The member with the most code points, then the smallest id, stays.

Large groups: the text aggregation combines copies before its shuffle, so a group sends one row from each map task. Row decisions travel by (hash, salt): each salt
first reduces its own rows, then the salts of a hash meet, and the answer goes back to the salts. No task holds a group.

Defined cases: a null text counts as empty and all empty texts are one group; a null id sorts after every id; of repeated rows (same id, same text) one is kept; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACES, Scratch, table

SALTS = 64


def squeeze(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", "")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = squeeze, key: Callable[[Column], Column] = lambda t: F.unhex(F.md5(t)), salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256. `key` is a parameter so that tests can make hashes collide."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"), normalise(F.col(text_col)).alias("norm"))
    texts = base.select(key(F.col("norm")).alias("key"), "norm").groupBy("key", "norm").agg(F.count("*").alias("n"))
    scratch = Scratch(spark, "exact")
    clash = scratch.save(texts.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"), "clash")

    rows = base.select("id", key(F.col("norm")).alias("key"), F.sha2("norm", 256).alias("sha"), F.length(F.coalesce("raw", F.lit(""))).cast("long").alias("points"), F.lit("").alias("exact"), "norm")
    if clash.isEmpty():
        rows = rows.drop("norm")
    else:  # the rows of such a hash are told apart by their text
        rows = rows.join(clash.withColumn("hit", F.lit(True)), "key", "left").withColumn("exact", F.when(F.col("hit"), F.col("norm")).otherwise(F.lit(""))).drop("norm", "hit")
    rows = scratch.save(rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")), "rows")

    group = ["key", "exact"]
    by_salt = rows.groupBy(*group, "salt").agg(F.count("*").alias("n"), F.max("points").alias("most"))
    most = by_salt.groupBy(*group).agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    longest = by_salt.select(*group, "salt").join(most, group)
    first = rows.join(longest, [*group, "salt"]).where("points = most").groupBy(*group, "n", "most").agg(F.min("id").alias("keep_id"))
    answer = by_salt.select(*group, "salt").join(first, group)
    one = Window.partitionBy(*group, "salt", "id").orderBy(F.desc("points"))
    return rows.join(answer, [*group, "salt"]).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(one) == 1)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that stay; of rows with one id and equal texts one, and rows with a null id stay."""
    decided = Scratch(docs.sparkSession, "exact").save(decide(docs, id_col).select(id_col, "kept"), "decided")
    by_id = decided.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    out = docs.join(by_id.where("not kept").select(id_col).hint("merge"), id_col, "left_anti")  # ids grow with the input: a shuffled join, whatever their size
    if not by_id.where("n > 1").isEmpty():
        out = out.where(F.col(id_col).isNull()).unionByName(out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
    return out.select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
