"""Versions of a store with several writers, restore behind its gate, the audit chain, and the ledger's scan over ranges."""

import random
import threading
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import audit, ledger, store, versions
from tallyforge.sources import backup


def values(spark, root, name):
    return sorted(r.n for r in store.published(spark, root, name).collect())


def number(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "n int")


def test_two_writers_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    store.publish({"t": number(spark, 0), "other": number(spark, 9)}, root)
    together, errors = threading.Barrier(2), []

    def writer(n):
        first = True

        def change(snap):
            nonlocal first
            now = snap.read("t")
            if first:  # both have read the same version before one of them writes
                first = False
                together.wait(60)
            return {"t": now.unionByName(number(spark, n))}

        try:
            versions.transact(spark, root, change)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=writer, args=(n,)) for n in (1, 2)]
    [t.start() for t in threads]
    [t.join(300) for t in threads]
    assert not errors and values(spark, root, "t") == [0, 1, 2] and values(spark, root, "other") == [9]
    assert versions.snapshot(spark, root).version == 3


def test_changes_of_other_tables_are_kept_without_doing_the_change_again(spark, tmp_path):
    root, calls = str(tmp_path), []
    store.publish({"a": number(spark, 1), "b": number(spark, 1)}, root)
    pinned = versions.snapshot(spark, root)

    def change(snap):
        calls.append(snap.version)
        if len(calls) == 1:
            store.publish({"b": number(spark, 5)}, root)  # somebody else, in between
        return {"a": snap.read("a").unionByName(number(spark, 2))}

    assert versions.transact(spark, root, change) == 3 and calls == [1]
    assert values(spark, root, "a") == [1, 2] and values(spark, root, "b") == [5]
    assert [r.n for r in pinned.read("b").collect()] == [1]  # a reader keeps to its version
    assert versions.commit(pinned, {"a": "nowhere"}) is None
    assert versions.expire(spark, root, 1) == 2
    assert values(spark, root, "a") == [1, 2] and [n for n in versions.Files(spark, root).names(f"{root}/manifests")] == [f"{3:012d}.json"]


def test_a_failed_change_leaves_the_store(spark, tmp_path):
    root = str(tmp_path)
    store.publish({"a": number(spark, 1)}, root)
    with pytest.raises(Exception, match="BAD"):
        store.publish({"a": number(spark, 2), "b": number(spark, 1).select(F.raise_error(F.lit("BAD")).cast("int").alias("n"))}, root)
    assert values(spark, root, "a") == [1] and versions.snapshot(spark, root).version == 1
    assert versions.snapshot(spark, f"{root}/none").names() == []


def odd_tables(spark):
    a = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-02 03:04:05.678901' AS t, TIMESTAMP_NTZ '2024-01-02 03:04:05.000007' AS n, 'ü \" \\\\ \\n' AS s, ARRAY(CAST(0.1 AS FLOAT), NULL) AS v, CAST(1.10 AS DECIMAL(9,2)) AS d UNION ALL SELECT 2, NULL, NULL, NULL, NULL, NULL")
    return {"a": a, "empty": a.limit(0), "b": number(spark, 1, 1, 2)}


def test_restore_replaces_the_store_or_nothing(spark, tmp_path):
    root, path = f"{tmp_path}/store", f"{tmp_path}/backup"
    tables = odd_tables(spark)
    backup.write(tables, path, "hash")
    store.publish({"old": number(spark, 7)}, root)
    assert backup.restore(spark, path, root) == 2
    now = versions.snapshot(spark, root)
    assert now.names() == ["a", "b", "empty"]
    assert sorted(map(str, now.read("a").collect())) == sorted(map(str, tables["a"].collect())) and now.read("empty").dtypes == tables["empty"].dtypes and values(spark, root, "b") == [1, 1, 2]
    bad = f"{tmp_path}/bad"
    for broken in ({"b": number(spark, 1, 1)}, {"b": number(spark, 1, 1, 3)}):
        backup.write(tables, bad)
        backup.as_json(broken["b"]).write.mode("overwrite").text(f"{bad}/b")
        with pytest.raises(backup.Broken, match="b$"):
            backup.restore(spark, bad, root)
    backup.write(tables, bad)
    header = spark.read.json(f"{bad}/_header_").withColumn("ddl", F.when(F.col("table") == "b", F.lit("n boolean")).otherwise(F.col("ddl"))).collect()
    spark.createDataFrame(header).coalesce(1).write.mode("overwrite").json(f"{bad}/_header_")
    with pytest.raises(backup.Broken, match="loaded rows of b"):  # the files are right, their types aren't
        backup.restore(spark, bad, root)
    with pytest.raises(backup.Broken, match="no header"):
        backup.restore(spark, _empty_header(spark, tmp_path), root)
    assert versions.snapshot(spark, root).version == 2 and values(spark, root, "b") == [1, 1, 2]


def _empty_header(spark, tmp_path):
    spark.createDataFrame([("x",)], "format string").write.json(f"{tmp_path}/none/_header_")
    return f"{tmp_path}/none"


def entries(spark, rows):
    return spark.createDataFrame(rows, "id long, entity string, action string, at long, payload string")


def test_audit_chain(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["create", "update", None]), i // 2, rng.choice(["{}", "{1}", None])) for i in range(60)]
    root = f"{tmp_path}/log"
    for n, part in enumerate((rows[:20], rows[20:25], rows[25:])):
        audit.append(entries(spark, part), n, root)
    audit.append(entries(spark, rows[20:25]), 1, root)  # a batch that comes again
    log = audit.log(spark, root)
    whole = audit.chained(entries(spark, rows))
    assert sorted(map(str, log.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    last = audit.heads(log)
    assert audit.breaks(log, last).collect() == []

    def found(changed):
        return {(r.entity, r.seq, r.reason) for r in audit.breaks(changed, last).collect()}

    own = "entity <=> 'a' and seq"
    n = log.where("entity = 'a'").count()
    assert found(log.where(f"not ({own} = 4)")) == {("a", 5, "missing")}
    assert found(log.withColumn("payload", F.when(F.expr(f"{own} = 3"), "other").otherwise(F.col("payload")))) == {("a", 3, "rewritten")}
    assert found(log.withColumn("hash", F.when(F.expr(f"{own} = 3"), "0").otherwise(F.col("hash")))) == {("a", 3, "rewritten")}
    assert found(log.unionByName(log.where(f"{own} = 2"))) == {("a", 2, "inserted")}
    assert found(log.where(f"not ({own} = {n})")) == {("a", n, "cut")}
    assert found(log.where("entity is null or entity <> 'a'")) == {("a", n, "cut")}


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_ledger_ranges_equal_a_plain_run(spark, ranges):
    rng = random.Random(ranges)
    kinds = [ledger.DEPOSIT, ledger.COVERAGE, ledger.COVERAGE, "other"]
    rows = [(k, n, ledger.ADJUSTMENT if rng.random() < 0.03 else rng.choice(kinds), D(rng.randint(-500, 90000)) / 100) for k in ("x", "y", None) for n in range(rng.randint(1, 150))]
    got = ledger.balances(spark.createDataFrame(rows, "k string, n int, type string, amount decimal(18,2)"), ["n"], ["k"], ranges).collect()
    balance, want = {}, {}
    for k, n, kind, a in rows:
        b = balance.get(k, D(0))
        b = max(D(0), b + a) if kind == ledger.DEPOSIT else max(D(0), b - a) if kind == ledger.COVERAGE else max(D(0), a) if kind == ledger.ADJUSTMENT else b
        balance[k] = want[(k, n)] = b
    assert {(r.k, r.n): r.balance_after for r in got} == want and len(got) == len(rows)


def test_one_ledger_is_spread_over_the_ranges(spark):
    rows = spark.range(8000).select(F.col("id").alias("n"), F.lit(ledger.DEPOSIT).alias("type"), F.lit(1).cast("decimal(18,2)").alias("amount"))
    sizes = [r["count"] for r in ledger.dealt(rows, ["n"], [], 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.25 * 8000
    assert ledger.balances(rows, ["n"], [], 8).where("balance_after <> n + 1").count() == 0
    assert ledger.balances(rows.limit(0), ["n"], [], 8).collect() == []


def test_a_backup_is_compressed(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from tallyforge.sources import backup

    rows = spark.range(20000).select("id", F.lit("the same text in every row").alias("text"))
    backup.write({"t": rows}, str(tmp_path), "hash")
    assert sum(os.path.getsize(f"{tmp_path}/t/{n}") for n in os.listdir(f"{tmp_path}/t")) < 20000 * 20
    assert backup.verify(spark, str(tmp_path)).first().ok and backup.read(spark, str(tmp_path), "t", "id long, text string").exceptAll(rows).isEmpty()
