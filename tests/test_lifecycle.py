"""Licence lifecycle: order and repeats of responses don't matter, a plain fold gives the same states, windows end by a timer."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from tallyforge.functions import forms, text
from tallyforge.operators import lifecycle, store
from tallyforge.streaming import devices

DDL = (
    "device_id string, seq bigint, at timestamp, kind string, status string, licence_code string, licence_type string, server_time timestamp, licence_ok boolean, licence_status string, licence_expires_at timestamp, "
    "licence_device string, receipt_ok boolean, receipt_until timestamp, receipt_expires_at timestamp, receipt_validated_at timestamp, receipt_device string"
)
NAMES = [part.split()[0] for part in DDL.split(", ")]
DAY = dt.datetime(2024, 1, 1)


def response(device, seq, kind, status, **more):
    row = dict.fromkeys(NAMES) | {"device_id": device, "seq": seq, "at": DAY + dt.timedelta(seq or 0), "kind": kind, "status": status, "licence_code": "abc"} | more
    return tuple(row[n] for n in NAMES)


def signed(until, **more):
    return {"licence_ok": True, "licence_status": "active", "receipt_ok": True, "receipt_until": until, "receipt_validated_at": DAY, "receipt_device": "d"} | more


def fold(rows):
    """The state of one device by applying its responses one after another."""
    s = None
    for r in sorted((dict(zip(NAMES, row)) for row in rows), key=lambda r: (r["at"], r["seq"])):
        receipt, doc = r["receipt_until"] if r["receipt_ok"] else None, r["licence_status"] if r["licence_ok"] else None
        if r["kind"] == "activate":
            if r["status"] in ("ACTIVATED", "ALREADY_ACTIVE") and r["licence_ok"] is not False:
                s = {"status": r["status"], "deactivation": None, "online": r["server_time"] or r["at"], "doc": doc, "until": receipt, "has": bool(r["receipt_ok"])}
        elif s and r["kind"] == "validate":
            if r["status"] == "VALID":
                s |= {"status": "VALID", "online": r["server_time"] or r["at"]}
                s |= {"doc": doc} if r["licence_ok"] else {}
                s |= {"until": receipt, "has": True} if r["receipt_ok"] else {}
            elif r["status"] in lifecycle.REFUSED:
                s["status"] = r["status"]
        elif s and r["kind"] == "deactivate":
            s |= {"status": "deactivated", "deactivation": "DEACTIVATED"} if r["status"] == "DEACTIVATED" else {"deactivation": "DEACTIVATION_PENDING_CONFIRMATION"}
    return s


def held(states):
    return {
        r.device_id: {"status": r.status, "deactivation": r.deactivation, "online": r.last_online, "doc": r.document and r.document.status, "until": r.receipt and r.receipt.until, "has": r.receipt is not None}
        for r in states.collect()
    }


def mixed(count):
    rng, rows = random.Random(7), []
    for device, seq in itertools.product([f"d{i}" for i in range(count)], range(9)):
        kind = rng.choice(["activate", "validate", "validate", "deactivate"])
        status = rng.choice({"activate": ["ACTIVATED", "ALREADY_ACTIVE", "INVALID_REQUEST"], "validate": ["VALID", "VALID", "LICENSE_REVOKED", "SERVER_ERROR", None], "deactivate": ["DEACTIVATED", "NETWORK_ERROR"]}[kind])
        flag = lambda: rng.choice([True, True, False, None])
        rows.append(response(device, seq, kind, status, licence_ok=flag(), licence_status="active", receipt_ok=flag(), receipt_until=rng.choice([None, DAY + dt.timedelta(seq + 3)]), server_time=rng.choice([None, DAY])))
    return rows


def test_states_are_those_of_a_plain_fold_in_any_order(spark, tmp_path):
    rows = mixed(40)
    want = {d: s for d, group in itertools.groupby(rows, key=lambda r: r[0]) if (s := fold(list(group)))}
    assert 20 < len(want) < 41
    shuffled = rows + rows[::3]  # some come twice
    random.Random(3).shuffle(shuffled)
    assert held(lifecycle.states(spark.createDataFrame(shuffled, DDL))) == want
    for part in range(3):  # three micro-batches
        spark.createDataFrame(shuffled[part::3], DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    log = devices.follow(source, f"{tmp_path}/states")
    assert held(devices.current(log)) == want
    log = devices.notices(source, f"{tmp_path}/out")
    assert held(devices.current(log)) == want
    count = log.count()
    spark.createDataFrame(shuffled[:50], DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # repeats change nothing and emit nothing
    assert held(devices.current(devices.follow(source, f"{tmp_path}/states"))) == want
    assert devices.notices(source, f"{tmp_path}/out").count() == count


def test_a_timer_tells_when_a_window_is_over(spark, tmp_path):
    soon = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(seconds=20)
    utc = lambda moment: moment.replace(tzinfo=dt.timezone.utc).astimezone().replace(tzinfo=None)
    rows = [response("d", 1, "activate", "ACTIVATED", **signed(utc(soon))), response("e", 1, "activate", "ACTIVATED", **signed(utc(soon + dt.timedelta(days=9)))), response("f", 1, "activate", "ACTIVATED")]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(DDL).parquet(f"{tmp_path}/in")
    first = {r.device_id: r.over for r in devices.windows(devices.notices(source, f"{tmp_path}/out")).collect()}
    assert first == {"d": False, "e": False, "f": None}
    while dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) < soon + dt.timedelta(seconds=1):
        spark.range(1).count()
    spark.createDataFrame([response("g", 1, "validate", "VALID")], DDL).write.mode("append").parquet(f"{tmp_path}/in")  # a micro-batch fires timers
    log = devices.notices(source, f"{tmp_path}/out")
    assert {r.device_id: r.over for r in devices.windows(log).collect()} == {"d": True, "e": False, "f": None}
    assert log.where("device_id = 'd'").count() == 2


def test_offline_checks_in_their_order(spark):
    until = DAY + dt.timedelta(30)
    base = signed(until)
    cases = {
        "ok": ({}, [], "VALID_OFFLINE"), "unsigned": ({"licence_ok": None}, [], "INVALID_LICENSE_SIGNATURE"), "revoked": ({"licence_status": "Revoked"}, [], "LICENSE_REVOKED"), "bare": ({"receipt_ok": False}, [], "RECEIPT_MISSING"),
        "moved": ({"receipt_device": "x"}, [], "DEVICE_MISMATCH"), "back": ({"server_time": DAY + dt.timedelta(25)}, [], "CLOCK_TAMPERING_DETECTED"), "none": ({"receipt_until": None}, [], "OFFLINE_WINDOW_EXPIRED"),
        "ended": ({"licence_expires_at": DAY + dt.timedelta(3)}, [], "LICENSE_EXPIRED"), "over": ({"receipt_until": DAY + dt.timedelta(3)}, [], "OFFLINE_WINDOW_EXPIRED"),
        "gone": ({}, [("deactivate", "DEACTIVATED"), ("validate", "VALID")], "LICENSE_DEACTIVATED"), "asked": ({}, [("deactivate", "SERVER_ERROR")], "VALID_OFFLINE"), "held": ({}, [("validate", "LICENSE_SUSPENDED")], "LICENSE_SUSPENDED"),
        "odd": ({}, [("validate", "INVALID_PRODUCT")], "INVALID_STATE"),
    }
    rows = [response(None, None, None, None), response("never", 1, "validate", "VALID"), response("forged", 1, "activate", "ACTIVATED", licence_ok=False)]
    for device, (more, later, _) in cases.items():
        rows.append(response(device, 1, "activate", "ACTIVATED", **(base | {"receipt_device": device} | more)))
        rows += [response(device, 2 + i, kind, status) for i, (kind, status) in enumerate(later)]
    found = lifecycle.offline(lifecycle.states(spark.createDataFrame(rows, DDL).withColumn("extra", F.lit(1))), "2024-01-20 00:00:00")
    assert {r.device_id: r.state for r in found.collect()} == {d: state for d, (_, _, state) in cases.items()}
    assert lifecycle.states(spark.createDataFrame([], DDL)).count() == 0


def test_marks_and_shown_texts(spark):
    base = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, None)], "id int, status string")
    marks = spark.createDataFrame([(1, "synced", 1), (1, "conflict", 2), (3, "synced", 1), (9, "synced", 1), (2, None, 4)], "id int, status string, at int")
    assert {tuple(r) for r in store.mark(base, marks, "id", "status", ["at"]).collect()} == {(1, "conflict"), (2, None), (3, "synced")}
    assert [r.id for r in store.unknown(base, marks, "id").collect()] == [9]
    rows = spark.createDataFrame([(None,), ("",), ("  ",), ("12345678",), (" 123456789 ",), ("2024-03-05",), ("2024--05",)], "t string")
    shown = [tuple(r) for r in rows.select(text.masked_code(F.col("t")), text.masked_device(F.col("t")), forms.shown_date(F.col("t"))).collect()]
    assert shown[:3] == [("***", "***", ""), ("***", "***", ""), ("****", "****", "  ")]
    assert shown[3:] == [("****", "****", "12345678"), ("1234-****-****-6789", "****", " 123456789 "), ("2024-****-****-3-05", "****", "05/03/2024"), ("****", "****", "2024--05")]


def test_tied_marks_count_in_the_order_of_the_table(spark, tmp_path):
    from tallyforge.plans import licence_plans

    day = dt.datetime(1998, 1, 1)
    n = 400
    spark.createDataFrame([(i,) for i in range(n)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = [(i, 1, flag, day) for i in range(n) for flag in (("A", "R") if i % 2 else ("R", "A"))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: r.sync_status for r in licence_plans.request_markers(spark, str(tmp_path)).collect()}
    assert got == {i: "synced" if i % 2 else "conflict" for i in range(n)}


def test_marks_without_a_day_or_of_one_day_count_as_in_sql(spark, tmp_path):
    import duckdb

    from tallyforge.plans import licence_plans

    spark.createDataFrame([(i,) for i in range(4)], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    at = lambda day, hour=0: dt.datetime(1998, 1, day, hour)
    rows = [(0, 1, "R", None), (1, 1, "R", at(1)), (1, 2, "A", None), (2, 2, "A", at(1)), (2, 1, "R", at(1, 9)), (3, 150, "R", at(1)), (3, 1, "A", at(2))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in licence_plans.request_markers(spark, str(tmp_path)).select("id", "sync_status").collect())
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert got == sorted(con.execute(licence_plans.ORACLE_SQL["request_markers"]).fetchall()) == [(0, "pending"), (1, "conflict"), (2, "synced"), (3, "conflict")]
