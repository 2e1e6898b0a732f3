"""Licence lifecycle: responses of a licence server to activate, validate and deactivate, folded into a state for each device.

Every field of a state is a register: it has the value of the latest response that wrote it. A response becomes the registers it writes, each a text that begins with the response's time, so of two
writes the greater text is the later one and a merge is a maximum. That is associative, commutative and idempotent: responses may come late, twice or in any order, rows of a device are combined
before they are shuffled, and the batch form (`states`) and the stream (`streaming/devices.py`) give the same states. A successful activation writes every register, so nothing before it counts.

A response: device_id, seq (breaks ties of time), at, kind (`activate`, `validate`, `deactivate`), status, licence_code, licence_type, server_time; of a signed licence licence_ok (the outcome of its
signature check, null without one), licence_status, licence_expires_at, licence_device; of a signed receipt receipt_ok, receipt_until, receipt_expires_at, receipt_validated_at, receipt_device.
Missing times and numbers count as the earliest; responses of unknown kind write nothing; further columns are ignored. Rows without a device are one device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a response, by what they do to a stored licence.
ACTIVE = ("ACTIVATED", "ALREADY_ACTIVE")
REFUSED = ("LICENSE_REVOKED", "LICENSE_EXPIRED", "LICENSE_SUSPENDED", "DEVICE_MISMATCH", "LICENSE_NOT_FOUND", "INVALID_PRODUCT", "INVALID_DEVICE")
VALID, DEACTIVATED, PENDING = "VALID", "DEACTIVATED", "DEACTIVATION_PENDING_CONFIRMATION"
#: Stored statuses (lower case) and statuses inside a signed licence, with the state of an offline check.
STORED_STATES = {
    "deactivated": "LICENSE_DEACTIVATED", "license_revoked": "LICENSE_REVOKED", "revoked": "LICENSE_REVOKED", "license_suspended": "LICENSE_SUSPENDED", "suspended": "LICENSE_SUSPENDED",
    "license_expired": "LICENSE_EXPIRED", "expired": "LICENSE_EXPIRED", "device_mismatch": "DEVICE_MISMATCH", "invalid_device": "DEVICE_MISMATCH", "license_not_found": "LICENSE_NOT_FOUND",
    "invalid_product": "INVALID_STATE", "activation_limit_reached": "INVALID_STATE", "invalid_request": "INVALID_STATE",
}
SIGNED_STATES = {"revoked": "LICENSE_REVOKED", "deactivated": "LICENSE_DEACTIVATED", "suspended": "LICENSE_SUSPENDED", "expired": "LICENSE_EXPIRED"}

#: What each register holds; times are microseconds.
REGISTERS = {
    "licence": "code string, type string, at bigint", "status": "v string", "ending": "v string", "online": "at bigint", "document": "status string, expires_at bigint, device string",
    "receipt": "until bigint, expires_at bigint, validated_at bigint, device string", "expiry": "at bigint",
}
_HEAD = 40


def _digits(number: Column, shift: int) -> Column:
    """A number as 20 digits that sort as it does; a missing one sorts first."""
    return F.lpad((F.coalesce(number, F.lit(-shift)).cast("decimal(20,0)") + F.lit(str(shift)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")


def writes(responses: DataFrame) -> DataFrame:
    """device_id and the registers that each response writes, null where it writes none. No shuffle; columns of a stream will do."""
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    status, kind = F.upper(F.trim("status")), F.lower(F.trim("kind"))
    signed, receipted = F.coalesce("licence_ok", F.lit(False)), F.coalesce("receipt_ok", F.lit(False))
    activates = (kind == "activate") & status.isin(*ACTIVE) & F.coalesce("licence_ok", F.lit(True)) & (F.trim("licence_code") != "")
    validates, ends = (kind == "validate") & (status == VALID), kind == "deactivate"
    done = ends & F.coalesce(status == DEACTIVATED, F.lit(False))
    gone = F.when(done, DEACTIVATED).when(ends, PENDING)
    end = F.coalesce(F.when(receipted, micros("receipt_expires_at")), F.when(signed, micros("licence_expires_at")))
    moment = F.coalesce(micros("server_time"), micros("at"))
    held = F.when(status.isin(*ACTIVE, VALID, *REFUSED), status)
    value = {
        "licence": (activates, [F.upper(F.trim("licence_code")).alias("code"), F.coalesce("licence_type", F.lit("beta_60_days")).alias("type"), micros("at").alias("at")]),
        "status": (activates | validates | ((kind == "validate") & status.isin(*REFUSED)) | done, [F.when(done, "deactivated").otherwise(held).alias("v")]),
        "ending": (activates | ends, [gone.alias("v")]),
        "online": (activates | validates, [moment.alias("at")]),
        "document": (activates | (validates & signed), [F.when(signed, c).alias(n) for n, c in (("status", F.coalesce("licence_status", F.lit(""))), ("expires_at", micros("licence_expires_at")), ("device", F.col("licence_device")))]),
        "receipt": (activates | (validates & receipted), [F.when(receipted, c).alias(n) for n, c in (("until", micros("receipt_until")), ("expires_at", micros("receipt_expires_at")), ("validated_at", F.coalesce(micros("receipt_validated_at"), F.lit(-1))), ("device", F.col("receipt_device")))]),
        "expiry": (activates | (validates & end.isNotNull()), [end.alias("at")]),
    }
    order = F.concat(_digits(micros("at"), 1 << 62), _digits(F.col("seq"), 1 << 63))
    return responses.select(F.col("device_id").cast("string").alias("device_id"), *[F.when(when, F.concat(order, F.to_json(F.struct(*fields)))).alias(name) for name, (when, fields) in value.items()])


def states(responses: DataFrame) -> DataFrame:
    """The state of each device that was ever activated: one aggregation, combined in each task before its shuffle."""
    return decoded(writes(responses).groupBy("device_id").agg(*[F.max(name).alias(name) for name in REGISTERS]))


def decoded(registers: DataFrame, *further: str) -> DataFrame:
    """device_id (text), licence_code, licence_type, activated_at, status, deactivation, last_online, document and receipt (null without), expires_at, and further columns. Devices without an activation have no state."""
    at = {n: F.from_json(F.substring(n, _HEAD + 1, 1 << 30), kind) for n, kind in REGISTERS.items()}
    time = F.timestamp_micros
    r, d = at["receipt"], at["document"]
    document = F.when(d["status"].isNotNull(), F.struct(d["status"].alias("status"), time(d["expires_at"]).alias("expires_at"), d["device"].alias("device")))
    seen = F.when(r["validated_at"] >= 0, r["validated_at"])
    receipt = F.when(r["validated_at"].isNotNull(), F.struct(time(r["until"]).alias("until"), time(r["expires_at"]).alias("expires_at"), time(seen).alias("validated_at"), r["device"].alias("device")))
    return registers.where(F.col("licence").isNotNull()).select(
        "device_id", at["licence"]["code"].alias("licence_code"), at["licence"]["type"].alias("licence_type"), time(at["licence"]["at"]).alias("activated_at"), at["status"]["v"].alias("status"),
        at["ending"]["v"].alias("deactivation"), time(at["online"]["at"]).alias("last_online"), document.alias("document"), receipt.alias("receipt"), time(at["expiry"]["at"]).alias("expires_at"), *further,
    )


def _state_of(text: Column, known: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.lower(F.coalesce(text, F.lit(""))))


def offline(held: DataFrame, now: str) -> DataFrame:
    """device_id, state and effective_until of a start without a network at `now`: the first check that fails, in a fixed order.

    Stored status, signed licence, its own status, receipt, device of both, the clock against both certified times, the end of the licence, the offline window. Only what was
    signed rightly is ever held, so signatures need no second look here. effective_until is the earlier of window and end, null where the checks did not come so far.
    """
    t, no = F.lit(now).cast("timestamp"), lambda c: F.coalesce(c, F.lit(False))
    d, r = F.col("document"), F.col("receipt")
    end = F.coalesce(r["expires_at"], d["expires_at"], "expires_at")
    other = no(r["device"] != F.col("device_id")) | no((d["device"] != "") & (d["device"] != F.col("device_id")))
    early = F.coalesce(
        F.when(F.col("deactivation") == DEACTIVATED, "LICENSE_DEACTIVATED"), _state_of(F.col("status"), STORED_STATES), F.when(d.isNull(), "INVALID_LICENSE_SIGNATURE"), _state_of(d["status"], SIGNED_STATES),
        F.when(r.isNull(), "RECEIPT_MISSING").when(other, "DEVICE_MISMATCH").when(no(t < F.col("last_online")) | no(t < r["validated_at"]), "CLOCK_TAMPERING_DETECTED").when(r["until"].isNull(), "OFFLINE_WINDOW_EXPIRED"),
    )
    late = F.when(no(t > end), "LICENSE_EXPIRED").when(t > r["until"], "OFFLINE_WINDOW_EXPIRED").otherwise("VALID_OFFLINE")
    return held.select("device_id", F.coalesce(early, late).alias("state"), F.when(early.isNull(), F.least(r["until"], end)).alias("effective_until"))
