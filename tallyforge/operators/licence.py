"""Licence states from stored facts. Signatures aren't checked here; a caller gives their outcome as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States with the reason shown for them, statuses of the server with the state of an offline check, days before the end of a window that warn.
REASONS = {"not_activated": "Licenza non attivata", "beta_expired": "Licenza beta scaduta", "suspended": "Licenza sospesa", "invalid": "Licenza non valida"}
SERVER_STATES = {
    "license_suspended": "LICENSE_SUSPENDED", "suspended": "LICENSE_SUSPENDED", "license_expired": "LICENSE_EXPIRED", "expired": "LICENSE_EXPIRED", "device_mismatch": "DEVICE_MISMATCH", "invalid_device": "DEVICE_MISMATCH",
    "license_not_found": "LICENSE_NOT_FOUND", "invalid_product": "INVALID_STATE", "activation_limit_reached": "INVALID_STATE", "invalid_request": "INVALID_STATE",
}
SOON = 5


def _days_until(moment: Column, now: str) -> Column:
    return (F.unix_micros(moment) - F.unix_micros(F.lit(now).cast("timestamp"))) / 86_400_000_000


def validity(licences: DataFrame, now: str) -> DataFrame:
    """licences (id, licence_id, licence_type, status, expires_at, remaining_days) with is_valid, state, days_left and reason. Without an end a licence never expires."""
    left = _days_until(F.col("expires_at"), now)
    none = F.coalesce("licence_id", F.lit("")) == ""
    known = F.when(none, "not_activated").when(F.col("status").isin(*REASONS), F.col("status"))
    over = known.isNull() & F.coalesce(left <= 0, F.lit(False))
    state = F.coalesce(known, F.when(over, F.when(F.col("licence_type") == "beta_60_days", "beta_expired").otherwise("invalid")), "status")
    reason = F.when(over, "Licenza scaduta").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), known))
    given = F.col("remaining_days")
    days = (
        F.when((known == "beta_expired") | over, 0).when(known == "suspended", given).when(known.isNotNull(), None).when(F.col("expires_at").isNotNull(), F.ceil(left).cast("int"))
        .otherwise(F.when(F.col("licence_type") != "lifetime_perpetual", given))
    )
    return licences.select("id", (known.isNull() & ~over).alias("is_valid"), state.alias("state"), days.alias("days_left"), reason.alias("reason"))


def window_flags(until: Column, valid: Column, now: str) -> tuple[Column, Column]:
    """Whether an offline window ends within SOON days, and whether it is over."""
    left = _days_until(until, now)
    return valid & F.coalesce(left.between(0, SOON), F.lit(False)), F.coalesce(left < 0, F.lit(False))


def offline_state(df: DataFrame, now: str) -> DataFrame:
    """df (id, server_status, signature_ok, window_until, expires_at, last_online, validated_at) with the state of an offline start, its checks in a fixed order, and effective_until."""
    t = F.lit(now).cast("timestamp")
    back = F.coalesce(t < F.col("last_online"), F.lit(False)) | F.coalesce(t < F.col("validated_at"), F.lit(False))
    until = F.least("window_until", "expires_at")  # the one that is there, if the other is missing
    server = F.try_element_at(F.create_map(*[F.lit(x) for kv in SERVER_STATES.items() for x in kv]), F.lower(F.coalesce("server_status", F.lit(""))))
    state = F.coalesce(server, F.when(~F.coalesce("signature_ok", F.lit(False)), "INVALID_LICENSE_SIGNATURE").when(back, "CLOCK_TAMPERING_DETECTED").when(t > until, "LICENSE_EXPIRED").otherwise("VALID"))
    return df.select("id", state.alias("state"), until.alias("effective_until"))


def rollbacks(log: DataFrame) -> DataFrame:
    """Entries of a log (device, seq, at) whose clock is behind the entry before."""
    before = F.lag("at").over(Window.partitionBy("device").orderBy("seq"))
    return log.withColumn("before", before).where("at < before").select("device", "seq")
