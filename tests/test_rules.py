"""Literal cases of the rules, one group of operators at a time."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import calendar, money, status
from tallyforge.functions import text as T
from tallyforge.operators import budget, closing, ledger, matching, receipts, reconcile, recurrence, reminders, store
from tallyforge.sources import backup
from tallyforge.streaming import live


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


D = Decimal


# money and calendar


@pytest.mark.parametrize(("x", "digits", "want"), [(-2.5, 0, -2.0), (2.5, 0, 3.0), (1.005, 2, 1.0), (0.125, 2, 0.13), (-0.125, 2, -0.12)])
def test_rounding(spark, x, digits, want):
    assert value(spark, money.js_round(F.lit(x), digits)) == want


@pytest.mark.parametrize(("x", "want"), [(0.0, "0,00 €"), (1250.5, "1250,50 €"), (-300.0, "-300,00 €"), (12345.678, "12.345,68 €")])
def test_italian_money(spark, x, want):
    assert value(spark, money.italian_text(F.lit(x))) == want


@pytest.mark.parametrize(("year", "month", "day", "want"), [(2026, 1, 31, "2026-01-31"), (2026, 2, 31, "2026-02-28"), (2024, 2, 30, "2024-02-29"), (2026, 5, 0, "2026-05-01"), (2026, 12, 15, "2026-12-15")])
def test_due_dates(spark, year, month, day, want):
    assert str(value(spark, calendar.due_date(F.lit(year * 12 + month), F.lit(day)))) == want


def test_recurrence_end_and_closing(spark):
    index = calendar.last_month_index(F.lit(2026 * 12 + 8), F.lit(6))
    assert (value(spark, calendar.year_of(index)), value(spark, calendar.month_of(index))) == (2027, 1)
    assert str(value(spark, calendar.closing_date(F.lit(2026), F.lit(12)))) == "2027-01-01"


@pytest.mark.parametrize(("kind", "want"), [("current_month", (2026, 1, 2026, 1)), ("last_two_months", (2025, 12, 2026, 1)), ("last_three_months", (2025, 11, 2026, 1)), ("last_four_months", (2025, 10, 2026, 1)), ("last_six_months", (2025, 8, 2026, 1)), ("current_year", (2026, 1, 2026, 12)), ("?", (2026, 1, 2026, 1))])
def test_periods(kind, want):
    assert calendar.period_range(kind, 2026, 1) == want


def test_chosen_period():
    assert calendar.period_range("choose_period", 2026, 1, 7) == (2026, 7, 2026, 7) and calendar.period_range("choose_period", 2026, 1) is None


@pytest.mark.parametrize(("state", "day", "want"), [("paid", "2026-08-01", "Pagata"), ("planned", "2026-08-01", "Scaduta"), ("planned", "2026-08-10", "In scadenza"), ("planned", "2026-12-01", "Pianificata"), ("toPay", "2026-12-01", "Da pagare"), ("Annullata", "2026-08-10", "Annullata"), ("planned", None, "Pianificata")])
def test_status_labels(spark, state, day, want):
    assert value(spark, status.expense_label(F.lit(state), F.lit(day).cast("date"), F.lit("2026-08-10").cast("date")))["label"] == want


# budget and ledger


def facts(spark, incomes, expenses):
    i = spark.createDataFrame([(D(a), s, dt.date(2026, 8, 5), 2026 * 12 + 8, "c1") for a, s in incomes], "amount decimal(18,2), status string, income_date date, ym int, contributor_id string")
    e = spark.createDataFrame([(D(a), s, dt.date(2026, 8, 9), 2026 * 12 + 8, n, c) for a, s, n, c in expenses], "amount decimal(18,2), status string, expense_date date, ym int, notified boolean, category_id string")
    quota = spark.createDataFrame([], "monthly_quota decimal(18,2), status string")
    return i, e, quota


def test_month_of_the_home_page(spark):
    i, e, q = facts(spark, [("1500", "received"), ("1200", "planned"), ("300", "received")], [("100", "paid", False, "a"), ("800", "planned", True, "a"), ("200", "planned", False, "b"), ("999", "cancelled", True, "b")])
    r = budget.monthly_summary(i, e, q, q).first()
    assert (r.total_income, r.total_received, r.total_expenses, r.paid_expenses, r.savings, r.prudential) == (3000, 1800, 1100, 100, 1900, 900)


def test_reserve_covers_a_deficit(spark):
    i, e, q = facts(spark, [("100", "received")], [("300", "paid", False, "a")])
    opening = spark.createDataFrame([(D("150"),)], "opening decimal(18,2)")
    r = budget.period_summary(i, e, q, q, opening, 2026 * 12 + 8, 2026 * 12 + 8).first()
    assert (r.deficit, r.reserve_used, r.uncovered, r.closing) == (200, 150, 50, 0)
    empty = budget.period_summary(i, e, q, q, opening, 2020 * 12 + 1, 2020 * 12 + 3).first()
    assert (empty.income, empty.expense, empty.closing, empty.months) == (0, 0, 150, 3)


def test_category_shares(spark):
    _, e, _ = facts(spark, [], [("300", "paid", False, "s1"), ("100", "paid", False, "zz"), ("50", "deleted", False, "s1")])
    c = spark.createDataFrame([("p", None, "Casa"), ("s1", "p", "Affitto")], "id string, parent_id string, name string")
    rows = [(r.category_id, r.category_name, r.amount, r.percentage) for r in budget.by_category(e, c).collect()]
    assert rows == [("p", "Casa", 300, 75), ("zz", "Altro", 100, 25)]


def test_ledger_closed_form_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.choice([ledger.DEPOSIT, ledger.COVERAGE, ledger.COVERAGE, ledger.ADJUSTMENT if rng.random() < 0.1 else ledger.DEPOSIT]), D(rng.randint(0, 90000)) / 100) for k in range(5) for n in range(80)]
    got = {(r.k, r.n): r.balance_after for r in ledger.balances(spark.createDataFrame(rows, "k int, n int, type string, amount decimal(18,2)"), ["n"], ["k"]).collect()}
    for k in range(5):
        b = D(0)
        for _, n, kind, a in [r for r in rows if r[0] == k]:
            b = max(D(0), b + a if kind == ledger.DEPOSIT else b - a if kind == ledger.COVERAGE else a)
            assert got[(k, n)] == b


def test_latest_balance_takes_the_first_of_a_tie(spark):
    rows = [(1, dt.date(2026, 1, 1), 5.0), (2, dt.date(2026, 2, 1), 7.0), (3, dt.date(2026, 2, 1), 9.0)]
    df = spark.createDataFrame(rows, "id long, movement_date date, balance_after double")
    assert ledger.latest_balance(df).first().balance == 7.0 and ledger.latest_balance(df.where("id > 9")).first().balance == 0.0


# recurrence and reminders


def fixed(spark, months):
    return spark.createDataFrame([("f", "Rata", D("250"), "monthly", 15, 2026 * 12 + 8, months, "active")], "id string, name string, expected_amount decimal(18,2), frequency string, due_day int, start_ym int, duration_months int, status string")


def test_recurrence_is_idempotent_and_resizes(spark):
    first = recurrence.by_duration(fixed(spark, 6))
    assert [(r.year, r.month) for r in first.orderBy("year", "month").collect()] == [(2026, 8), (2026, 9), (2026, 10), (2026, 11), (2026, 12), (2027, 1)]
    count = lambda wanted, stored: {r.action: r["count"] for r in recurrence.reconcile(wanted, stored).groupBy("action").count().collect()}
    assert count(first, first) == {"keep": 6}
    assert count(recurrence.by_duration(fixed(spark, 8)), first) == {"keep": 6, "insert": 2}
    assert count(recurrence.by_duration(fixed(spark, 4)), first) == {"keep": 4, "delete": 2}
    assert count(recurrence.by_duration(fixed(spark, 4)), first.withColumn("status", F.lit("paid"))) == {"keep": 6}


def test_reminders_go_out_once(spark):
    e = spark.createDataFrame([(1, D("10.5"), dt.date(2026, 8, 12), "planned", 7, "", "manual"), (2, D("3"), dt.date(2026, 8, 11), "planned", None, "Luce", "fixedExpense"), (3, D("3"), dt.date(2026, 8, 11), "paid", None, "x", "manual"), (4, D("3"), dt.date(2026, 8, 20), "planned", None, "x", "manual")], "id long, amount decimal(18,2), expense_date date, status string, supplier_id long, description string, entry_mode string")
    s = spark.createDataFrame([(7, "Enel")], "id long, name string")
    c = spark.createDataFrame([(1, True, True, " a@b.c ", True, False), (2, True, True, "d@e.f", True, True), (3, False, True, "g@h.i", True, True)], "id long, active boolean, receive_emails boolean, email string, receive_48h boolean, receive_24h boolean")
    sent = spark.createDataFrame([], "unique_key string")
    rows = {r.expense_id: r for r in reminders.generate(e, s, c, sent, "2026-08-10").collect()}
    assert rows[1].title == "Scadenza Enel tra 48 ore" and rows[1].message == "La spesa Enel di €10.50 scade il 2026-08-12." and rows[1].recipients == "a@b.c,d@e.f"
    assert rows[2].unique_key == "fixedExpense_2_2026-08-11_24h" and rows[2].recipients == "d@e.f" and set(rows) == {1, 2}
    again = reminders.generate(e, s, c, spark.createDataFrame([(r.unique_key,) for r in rows.values()], "unique_key string"), "2026-08-10")
    assert again.isEmpty()


# receipts


TEXT = """SUPERMERCATO DESPAR S.R.L.
VIA GARIBALDI 12
20100 MILANO
P.IVA 01234567897
DOCUMENTO COMMERCIALE
DATA 15/06/2026 ORE 14:30
-----
PANE FRESCO 1,20
SCONTO -0,20
PASTA BARILLA 500G 2,50
MELE 2 x 1,50 3,00
RESO BOTTIGLIA 0,50
SUBTOTALE 6,20
TOTALE COMPLESSIVO 6,00
CONTANTI 10,00
RESTO 4,00"""


def test_a_whole_receipt(spark):
    r = receipts.parse(spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, text string"), now="2026-07-01").orderBy("id").collect()
    one = r[0]
    assert (one.supplier.value, one.date.value, one.time, one.total.value, one.subtotal, one.payment.value, one.tax_number.value, one.tax_number.confidence) == ("SUPERMERCATO DESPAR S.R.L.", "2026-06-15", "14:30", 6.0, 6.2, "contanti", "P.IVA 01234567897", 95)
    assert one.address.value == "VIA GARIBALDI 12 - 20100 MILANO"
    assert [(i.description, i.line_total, i.discount) for i in one["items"]] == [("PANE FRESCO", 1.0, 0.2), ("PASTA BARILLA 500G", 2.5, 0.0), ("MELE 2 x 1,50", 3.0, 0.0), ("RESO BOTTIGLIA", -0.5, 0.0)]
    assert one.vat is None and one.flags == []
    assert r[1].flags == r[2].flags == ["MISSING_TOTAL_WARNING", "SCANTY_TEXT_WARNING"]


@pytest.mark.parametrize(("text", "want"), [("1.234,56", 1234.56), ("24.50", 24.5), ("-2,50", -2.5), ("2,50-", -2.5), ("1,234.56", 1234.56), ("O,75", 0.75), ("l2,00", 12.0), ("€ 3,10", 3.1), ("abc", None), ("", None), (None, None)])
def test_italian_numbers(spark, text, want):
    assert value(spark, T.italian_number(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("number", "ok"), [("01234567897", True), ("12345678901", False), ("1234", False), ("1234567890a", False)])
def test_tax_numbers(spark, number, ok):
    assert value(spark, T.vat_number_ok(F.lit(number))) is ok


def test_flyer_dates_lose_to_the_document_date(spark):
    text = "OFFERTA VALIDA DAL 01/05/2026 AL 20/05/2026\nDATA 12/05/2026 ORE 14:30"
    r = spark.createDataFrame([(text,)], "t string").select(receipts.lines_of(F.col("t")).alias("lines")).select(receipts.date().alias("d"), receipts.time().alias("t")).first()
    assert (r.d.value, r.t) == ("2026-05-12", "14:30")


def test_folding_rules(spark):
    def fold(*lines):
        row = spark.createDataFrame([(list(lines),)], "lines array<string>").select(receipts.line_items().alias("items")).first()
        return [(i["description"], i["line_total"], i["warning"]) for i in row["items"]]

    assert fold("PANE 1,20", "SCONTO -0,20", "COUPON -1,00") == [("PANE", 1.0, None), ("COUPON", -1.0, "DISCOUNT_LINE")]
    assert fold("LATTE -1,20", "VUOTO 2,00-") == [("LATTE", -1.2, None), ("VUOTO", -2.0, None)]
    assert fold("PANE 1,00", "FORMAGGIO STAGIONATO", "DOLCE 4,00") == [("PANE", 1.0, None), ("FORMAGGIO STAGIONATO DOLCE", 4.0, None)]
    assert fold("ARTICOLI 3", "ACQUA 0,40", "TOTALE 0,40", "DOPO 9,00") == [("ACQUA", 0.4, None)]
    assert fold() == []


# text and matching


def test_text_functions(spark):
    assert value(spark, T.normalise(F.lit(" Pasta, di  semola/500g. "))) == "PASTA DI SEMOLA 500G"
    assert value(spark, T.catalogue_name(F.lit("Offerta pasta di semola"))) == "PASTA DI SEMOLA"
    assert value(spark, T.unit(F.lit("ACQUA 6x33 cl"))) == "6X33CL" and value(spark, T.unit(F.lit("FARINA 500 gr"))) == "500G"
    assert value(spark, T.barcode(F.lit("COD 8001234567890 X"))) == "8001234567890" and value(spark, T.barcode(F.lit("123456789"))) is None
    assert value(spark, T.brand(F.lit("spaghetti barilla n5"))) == "BARILLA" and value(spark, T.brand(F.lit("BARILLAX"))) is None
    assert value(spark, T.masked(F.lit("ABCDEFGH"))) == "****EFGH"


def test_jaccard_is_symmetric_and_bounded(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc ", k=rng.randint(0, 8)))
    df = spark.createDataFrame([(word(), word()) for _ in range(60)], "a string, b string")
    x, y = T.trigrams(F.col("a")), T.trigrams(F.col("b"))
    assert df.where((T.jaccard(x, y) != T.jaccard(y, x)) | (T.jaccard(x, y) < 0) | (T.jaccard(x, y) > 1)).isEmpty()


def test_match_levels(spark):
    lines = spark.createDataFrame([(1, "PASTA", 1.0), (2, "XY", 1.0), (3, "SCONTO", 1.0), (4, "PANE", 1.0)], "line_id int, description string, line_total double").withColumn("norm", F.col("description"))
    c = spark.createDataFrame([(1, 10, 100.0, "exact_barcode"), (1, 11, 60.0, "fingerprint"), (4, 10, 82.0, "fingerprint"), (4, 11, 75.0, "exact_name")], "line_id int, product_id int, score double, kind string")
    got = {r.line_id: (r.product_id, r.level, r.conflict, r.proposes_product) for r in matching.decide(lines, c).collect()}
    assert got == {1: (10, "exact", None, False), 2: (None, "unresolved", "short_description", True), 3: (None, "unresolved", None, False), 4: (10, "unresolved", "ambiguous_products", False)}


# store, closing, reconciliation


def test_store_operations(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, name string, version int")
    assert sorted(map(tuple, store.patch(base, spark.createDataFrame([(2, "z")], "id int, name string"), "id").collect())) == [(1, "a", 1), (2, "z", 2)]
    assert sorted(map(tuple, store.last_write(base, spark.createDataFrame([(2, "y", 5), (3, "c", 1)], base.schema), ["id"], ["version"]).collect())) == [(1, "a", 1), (2, "y", 5), (3, "c", 1)]
    assert store.beyond(base, [], ["id"], 1).count() == 1
    for n in (1, 2):
        store.publish({"t": base.limit(n)}, str(tmp_path))
        assert store.published(spark, str(tmp_path), "t").count() == n


def test_late_receipts_keep_their_month_final(spark):
    reports = spark.createDataFrame([(2026, 4, "final", dt.datetime(2026, 5, 1), D("100"), D("100"))], "year int, month int, status string, closed_at timestamp, total_expenses decimal(18,2), paid_expenses decimal(18,2)")
    incoming = spark.createDataFrame([("p1", D("35"), dt.date(2026, 4, 12)), ("p1", D("35"), dt.date(2026, 4, 12)), ("p2", D("0"), dt.date(2026, 4, 1)), ("p3", D("5"), dt.date(2026, 4, 3))], "process_id string, amount decimal(18,2), expense_date date")
    known = spark.createDataFrame([("p3",)], "process_id string")
    accepted, audit = closing.register_late(known, incoming, reports, "2026-08-01")
    assert [(r.process_id, r.late) for r in accepted.collect()] == [("p1", True)] and audit.first().new_values["isLateRegistration"] == "true"
    r = closing.recompute(reports, accepted).first()
    assert (r.status, r.total_expenses) == ("final", D("135.00"))


def test_reconciliation_outcomes(spark):
    schema = "id string, status string, linked string, updated_at int"
    local = spark.createDataFrame([("a", "new", None, 1), ("b", "new", None, 9), ("c", "new", None, 9), ("d", "new", None, 1)], schema).withColumn("sync_status", F.lit("pending"))
    remote = spark.createDataFrame([("a", "new", None, 5), ("b", "closed", "k", 5), ("c", "in_review", None, 5), ("d", "in_review", None, 5), ("e", "new", None, 5)], schema)
    got = {r.id: (r.outcome, r.sync_status, r.status) for r in reconcile.apply_remote(local, remote, ["status", "linked"], ["status", "linked"]).collect()}
    assert got == {"a": ("equivalent", "synced", "new"), "b": ("applied", "synced", "closed"), "c": ("conflict", "conflict", "new"), "d": ("applied", "synced", "in_review"), "e": ("missing_local_record", None, None)}


def test_backups_and_documents(spark, tmp_path):
    t = spark.createDataFrame([(1, "é"), (2, None)], "id int, name string")
    backup.write({"t": t, "u": t.limit(0)}, str(tmp_path / "b"))
    assert all(r.ok for r in backup.verify(spark, str(tmp_path / "b")).collect())
    assert sorted(map(tuple, backup.read(spark, str(tmp_path / "b"), "t", "id int, name string").collect())) == [(1, "é"), (2, None)]
    (tmp_path / "b" / "t" / "part-x.txt").write_text('{"id":9,"name":"x"}\n')
    assert not all(r.ok for r in backup.verify(spark, str(tmp_path / "b")).collect())
    (tmp_path / "in").mkdir()
    for name, data in (("a.jpg", b"12"), ("b.PNG", b"12"), ("c.pdf", b"345"), ("d.txt", b"6")):
        (tmp_path / "in" / name).write_bytes(data)
    assert backup.documents(spark, str(tmp_path / "in")).count() == 2


def test_stream_counts_a_late_fact(spark, tmp_path):
    src = str(tmp_path / "src")
    row = lambda i, month: (i, dt.datetime(2026, month, 5), 7, "buy", 2.0, "{}")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    count = lambda f: f.groupBy("ym").agg(F.count("*").alias("n"))
    for batch in ([row(1, 3), row(2, 4)], [row(3, 3)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(src)
        facts = live.events(spark, src).select((F.year("ts") * 12 + F.month("ts")).alias("ym"), "value")
        live.late_months(facts, str(tmp_path / "facts"), count, str(tmp_path / "reports"), str(tmp_path / "cp"))
    assert {r.ym - 2026 * 12: r.n for r in spark.read.parquet(str(tmp_path / "reports")).collect()} == {3: 2, 4: 1}


def test_attachments_without_an_expense_stay_in_their_tasks(spark):
    from tallyforge.operators import lists

    attachments = spark.range(0, 400, 1, 4).select(F.col("id").alias("attachment_id"), F.when(F.col("id") % 20 == 0, F.col("id")).alias("expense_id"))
    expenses = spark.range(0, 400, 40).select(F.col("id").alias("expense_id"), F.lit("Spesa").alias("description"), F.when(F.col("id") > 0, F.lit(1)).alias("supplier_id"))
    suppliers = spark.createDataFrame([(1, "Rossi")], "id int, name string")
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        rows = lists.attachment_owners(attachments, expenses, suppliers).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in confs:
            spark.conf.unset(k)
    assert sorted((r.attachment_id, r.expense_id, r.description, r.supplier_name) for r in rows) == [
        (i, i if i % 20 == 0 else None, "Spesa" if i % 40 == 0 else "", "Rossi" if i % 40 == 0 and i else "") for i in range(400)
    ]
    assert max(sum(r.task == t for r in rows) for t in {r.task for r in rows}) <= 110


def test_candidates_of_a_field_are_made_once(spark):
    df = spark.createDataFrame([("A",)], "text string").select(F.split("text", "\n").alias("lines"))
    most = {receipts.supplier: 4, receipts.date: 6, receipts.payment: 16, receipts.total: 8, receipts.tax_number: 4, receipts.address: 10}
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        reads = {parser: df.select(parser().alias("x"))._jdf.queryExecution().analyzed().toString().count("lines#") for parser in most}
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [p.__name__ for p, n in reads.items() if n > most[p]] == []


def test_rows_and_arrays_of_lines_give_the_same_fields(spark):
    words = ["PANE", "x", "500 g", "A", "SCONTO -0,30", "COUPON 1,00", "RESO", "TOTALE EURO 5,00", "SUBTOTALE", "RESTO", "CARTA", "VIA ROMA 1", "P.IVA 01234567897", "DATA 12/05/2026", "3.4.25", "ORE 14:30", "MELE 2 x 1,50", "€", "  ", "***", "20100 MILANO", "IVA 22% 1,10", "12,345,67", "0,00", "2,00-", "*- ", "1"]
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices(words, k=rng.randint(0, 3))) + rng.choice(["", f" {rng.randint(0, 20)},{rng.randint(0, 99):02d}"])
    texts = [(i % 150, None if i == 7 else "\n".join(line() for _ in range(rng.randint(0, 16)))) for i in range(300)]  # two receipts for each key
    df = spark.createDataFrame(texts, "id int, text string")
    names = sorted(receipts.PARSERS)
    rows = receipts.fields(df, names, key=["id"]).select("id", F.to_json(F.struct("lines", *names)).alias("j"))
    arrays = df.withColumn("lines", receipts.lines_of(F.col("text"))).select("id", F.to_json(F.struct("lines", *[receipts.PARSERS[n]().alias(n) for n in names])).alias("j"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, arrays.collect()))


def test_repeated_items_need_no_other_field(spark):
    from tallyforge.plans import screen_plans

    plan = screen_plans.receipt_duplicate_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "PAGOBANCOMAT" not in plan and plan.count("aggregate(") == 1  # one fold of the items, no look for a payment
    two = spark.createDataFrame([("PANE 1,00\npane 1,00",), ("PANE 1,00\nPANE 2,00",)], "text string")
    assert [r[0] for r in receipts.fields(two.coalesce(1), ["items"]).select("text", receipts.repeated(F.col("items")).alias("r")).orderBy("text").select("r").collect()] == [False, True]
