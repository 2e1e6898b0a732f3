"""Reconciliation of local records with remote answers: a full outer join and one ordered conditional."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Remote statuses that end a request and always win.
TERMINAL = ("approved", "rejected", "closed", "converted")


def apply_remote(local: DataFrame, remote: DataFrame, business: list[str], remote_fields: list[str], terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Each remote record's outcome and the local record after it.

    missing_local_record: nothing is inserted; equivalent: business fields equal (nulls equal each other); applied: a terminal status, or no newer local change is pending;
    conflict: a pending local change is newer. remote_fields are taken from the remote record when it is applied.
    """
    r = remote.select("id", *[F.col(c).alias(f"r_{c}") for c in remote.columns if c != "id"], F.lit(True).alias("_remote"))
    both = local.withColumn("_local", F.lit(True)).join(r, "id", "full").where("_remote")
    same = F.lit(True)
    for c in business:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    newer = (F.col("sync_status") == "pending") & (F.col("updated_at") > F.col("r_updated_at"))
    outcome = F.when(F.col("_local").isNull(), "missing_local_record").when(same, "equivalent").when(F.col("r_status").isin(*terminal), "applied").when(newer, "conflict").otherwise("applied")
    both = both.withColumn("outcome", outcome)
    take = F.col("outcome") == "applied"
    fields = [F.when(take, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in remote_fields]
    sync = F.when(F.col("outcome").isin("applied", "equivalent"), "synced").when(F.col("outcome") == "conflict", "conflict").otherwise(F.col("sync_status"))
    updated = F.when(take, F.coalesce("r_updated_at", "updated_at")).otherwise(F.col("updated_at"))
    return both.select("id", "outcome", *fields, sync.alias("sync_status"), updated.alias("updated_at"))
