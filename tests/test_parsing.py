"""Parsed lines merged into stored ones: what is replaced and kept, and batches that come again."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyforge.operators import parsing, store, versions

PROCESSES = "id string, status string, error string, supplier string, day string, total double, replaced bigint, kept bigint"
LINES = "id string, process_id string, position int, description string, line_total decimal(18,2), confidence int, review_status string"
TEXTS = "process_id string, text string"


def receipt(*items):
    return "MERCATO ROSSI S.R.L.\nVIA ROMA 1\n" + "\n".join(f"{name} {price}" for name, price in items) + "\n-----\nTOTALE EURO 5,00\n"


def test_merge(spark, tmp_path):
    root = str(tmp_path)
    processes = [(p, "pending", None, None, None, None, None, None) for p in ("a", "b", "c")]
    lines = [(f"{p}{s[0]}", p, 0, "old", D(1), 1, s) for p in ("a", "b", "c") for s in ("pending", "rejected", "confirmed", "edited")]
    store.publish({"processes": spark.createDataFrame(processes, PROCESSES), "lines": spark.createDataFrame(lines, LINES), "batches": spark.createDataFrame([], parsing.BATCHES)}, root)
    one = spark.createDataFrame([("a", receipt(("LATTE FRESCO", "1,50"), ("PANE CASERECCIO", "3,50"))), ("a", None), ("b", " \n\t"), ("x", receipt(("LATTE FRESCO", "1,50"))), (None, "y")], TEXTS)

    def state():
        now = versions.snapshot(spark, root)
        return {r.id: (r.status, r.error, r.replaced, r.kept) for r in now.read("processes").collect()}, sorted((r.id, r.description, str(r.line_total), r.review_status) for r in now.read("lines").collect())

    assert parsing.apply_batch(spark, root, one, 0) == 2
    first = state()
    old = lambda p, *kinds: [(f"{p}{k[0]}", "old", "1.00", k) for k in kinds]
    rest = old("b", "confirmed", "edited", "pending", "rejected") + old("c", "confirmed", "edited", "pending", "rejected")
    made = lambda n: [(f"a-{n}-0", "LATTE FRESCO", "1.50", "pending"), (f"a-{n}-1", "PANE CASERECCIO", "3.50", "pending")]
    assert first[0] == {"a": ("completed", None, 2, 2), "b": ("failed", parsing.EMPTY, None, None), "c": ("pending", None, None, None)}
    assert first[1] == sorted(made(0) + old("a", "confirmed", "edited") + rest)
    assert parsing.apply_batch(spark, root, one, 0) is None and state() == first  # the batch comes again
    assert parsing.apply_batch(spark, root, one, 1) == 3  # the same texts as a new batch: the lines before are replaced
    assert state()[1] == sorted(made(1) + old("a", "confirmed", "edited") + rest) and state()[0]["a"] == ("completed", None, 2, 2)
    assert parsing.apply_batch(spark, root, one.limit(0), 2) == 4 and state()[1] == sorted(made(1) + old("a", "confirmed", "edited") + rest)
    assert versions.snapshot(spark, root).read("batches").orderBy("number").agg(F.collect_list("number")).first()[0] == [0, 1, 2]


def test_merge_broadcasts_nothing(spark, tmp_path):
    root, number = str(tmp_path / "store"), "number bigint"
    store.publish({"processes": spark.createDataFrame([("a",) + (None,) * 7], PROCESSES), "lines": spark.createDataFrame([], LINES), "batches": spark.createDataFrame([], number)}, root)
    spark.createDataFrame([("a", receipt(("LATTE FRESCO", "1,50")))], TEXTS).write.parquet(f"{tmp_path}/texts")
    now = versions.snapshot(spark, root)
    out = parsing.merge({t: now.read(t) for t in parsing.TABLES}, spark.read.parquet(f"{tmp_path}/texts"), 1)
    for name in ("processes", "lines"):
        assert "BroadcastExchange" not in out[name]._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_and_parsed_once(spark, tmp_path):
    root = str(tmp_path / "store")
    store.publish({"processes": spark.createDataFrame([(p,) + (None,) * 7 for p in "ab"], PROCESSES), "lines": spark.createDataFrame([], LINES), "batches": spark.createDataFrame([], parsing.BATCHES)}, root)
    spark.createDataFrame([("a", receipt(("LATTE FRESCO", "1,50"))), ("b", " ")], TEXTS).write.parquet(f"{tmp_path}/texts")
    now = versions.snapshot(spark, root)
    out = parsing.merge({t: now.read(t) for t in parsing.TABLES}, spark.read.parquet(f"{tmp_path}/texts"), 1, f"{tmp_path}/parsed")
    for name in ("processes", "lines"):
        plan = out[name]._jdf.queryExecution().executedPlan().toString()
        assert f"{tmp_path}/texts" not in plan and "regexp_extract" not in plan and f"{tmp_path}/parsed" in plan
    assert {r.id: r.status for r in out["processes"].collect()} == {"a": "completed", "b": "failed"}
