"""An append-only audit log with a chain of hashes for each entity.

An entry's hash covers the hash before it, its number and its content, so a rewritten, removed or inserted entry breaks the chain at a place that `breaks` names. `heads` (the last number
and hash of each entity) also tell that the end of a chain is gone.

`append` is idempotent: the entries of a batch have a folder of their own by the batch's number, and a batch that comes again replaces what it wrote, from the heads of the batches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.versions import Files

FIRST = ""
CONTENT = ("action", "at", "payload")


def _hash(before: Column, seq: Column, content: list[Column]) -> Column:
    # lengths keep the fields apart; a null has none
    fields = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in content]
    return F.sha2(F.concat_ws("|", before, seq.cast("string"), *fields), 256)


def chained(entries: DataFrame, heads: DataFrame | None = None, order: tuple[str, ...] = ("at", "id")) -> DataFrame:
    """entries (id, entity, action, at, payload; text but for at) with seq, prev_hash and hash, after the heads (entity, seq, hash) of the chains so far.

    The chain of an entity is made by one fold over its new entries, without other entities: as many as a batch has of it.
    """
    kind = "struct<seq:bigint,hash:string,out:array<struct<id:bigint,action:string,at:string,payload:string,seq:bigint,prev_hash:string,hash:string>>>"
    row = F.struct(*order, F.struct("id", "action", F.col("at").cast("string").alias("at"), "payload").alias("e"))
    new = entries.groupBy("entity").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    if heads is not None:
        known = heads.select(F.col("entity").alias("_entity"), F.col("seq").alias("_seq"), F.col("hash").alias("_hash"))
        new = new.join(known, F.col("entity").eqNullSafe(F.col("_entity")), "left").drop("_entity")
    else:
        new = new.withColumns({"_seq": F.lit(None).cast("bigint"), "_hash": F.lit(None).cast("string")})
    start = F.struct(F.coalesce("_seq", F.lit(0)).cast("bigint").alias("seq"), F.coalesce("_hash", F.lit(FIRST)).alias("hash"), F.array().alias("out")).cast(kind)

    def step(acc: Column, r: Column) -> Column:
        e, seq = r["e"], acc["seq"] + 1
        h = _hash(acc["hash"], seq, [e[c] for c in CONTENT])
        link = F.struct(e["id"].alias("id"), *[e[c].alias(c) for c in CONTENT], seq.alias("seq"), acc["hash"].alias("prev_hash"), h.alias("hash"))
        return F.struct(seq.alias("seq"), h.alias("hash"), F.array_append(acc["out"], link).alias("out")).cast(kind)

    return new.select("entity", F.explode(F.aggregate("rows", start, step)["out"]).alias("x")).select("entity", "x.*")


def heads(log: DataFrame) -> DataFrame:
    """The last number and hash of each entity."""
    return log.groupBy("entity").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def append(batch: DataFrame, number: int, root: str) -> None:
    """Append a batch of entries; the same number again replaces what it wrote."""
    spark = batch.sparkSession
    before = _batches(spark, root, number)
    known = None
    if before:
        # of the entities of this batch, as the batches before it left them
        touched = batch.select(F.col("entity").alias("_entity")).distinct()
        known = heads(spark.read.parquet(*before).join(touched, F.col("entity").eqNullSafe(F.col("_entity")), "left_semi"))
    chained(batch, known).write.mode("overwrite").parquet(f"{root}/batch={number:012d}")


def _batches(spark: SparkSession, root: str, below: int | None = None) -> list[str]:
    names = [n for n in Files(spark, root).names(root) if n.startswith("batch=")]
    return [f"{root}/{n}" for n in names if below is None or int(n[6:]) < below]


def log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(*_batches(spark, root))


def breaks(entries: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The first broken link of each entity whose chain is broken: entity, seq, reason.

    Reasons: rewritten (the hash isn't that of the content), missing (a number is skipped), inserted (a number comes again), unlinked (prev_hash isn't the hash before), and, with
    the heads of the log, cut (the end is gone; seq is the last number that should be there).
    """
    by = Window.partitionBy("entity").orderBy("seq", "id")
    rows = entries.select("entity", "seq", "id", "prev_hash", "hash", *CONTENT, F.coalesce(F.lag("seq").over(by), F.lit(0)).alias("_seq"), F.coalesce(F.lag("hash").over(by), F.lit(FIRST)).alias("_hash"))
    reason = F.when(F.col("seq") > F.col("_seq") + 1, "missing").when(F.col("seq") < F.col("_seq") + 1, "inserted").when(F.col("prev_hash") != F.col("_hash"), "unlinked")
    reason = reason.when(F.col("hash") != _hash(F.col("prev_hash"), F.col("seq"), [F.col(c) for c in CONTENT]), "rewritten")
    found = rows.select("entity", "seq", reason.alias("reason")).where("reason is not null")
    if last is not None:
        there = entries.groupBy(F.col("entity").alias("_entity")).agg(F.max("seq").alias("_is"))
        ends = last.join(there, F.col("entity").eqNullSafe(F.col("_entity")), "left").where(F.coalesce("_is", F.lit(0)) < F.col("seq"))
        found = found.unionByName(ends.select("entity", "seq", F.lit("cut").alias("reason")))
    return found.groupBy("entity").agg(F.min(F.struct("seq", "reason")).alias("x")).select("entity", "x.*")
