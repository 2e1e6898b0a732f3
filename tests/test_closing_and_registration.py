"""Closing states as of an instant, and registration with categories by code, subcategories and links."""

import datetime as dt
import random
from decimal import Decimal as D

from tallyforge.operators import closing, registration


def test_state_of_a_month_when_a_fact_arrived(spark):
    rng = random.Random(1)
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    history = [(rng.choice([1, 2, 3, None]), at(rng.randint(0, 20)), rng.choice(["final", "provisional"])) for _ in range(25)] + [(1, None, "final"), (2, at(3), "final"), (2, at(3), "provisional")]
    facts = [(i, rng.choice([1, 2, 3, 4, None]), rng.choice([None, *map(at, range(-1, 24))])) for i in range(150)]
    got = closing.as_of(spark.createDataFrame(facts, "id int, ym int, at timestamp"), spark.createDataFrame(history, "ym int, at timestamp, status string")).collect()
    assert len(got) == len(facts)
    for r in got:
        before = sorted((t, s) for m, t, s in history if m is not None and m == r.ym and t is not None and r.at is not None and t <= r.at)
        status, since = (before[-1][1], before[-1][0]) if before else ("provisional", None)
        assert (r.month_status, r.month_since, r.late) == (status, since, status == "final")


def test_registration(spark):
    docs = [(1, D(10), False, None, None, "S", "s1", None), (2, D(0), False, None, None, None, None, None), (3, D(9), False, "A", None, "S", None, None), (4, D(5), True, None, None, None, None, "p9"), (5, D(5), False, None, None, None, None, None)]
    docs = spark.createDataFrame(docs, "document_id int, total decimal(18,2), approved boolean, category_id string, subcategory_id string, supplier_category string, supplier_subcategory string, process_id string")
    docs = docs.selectExpr("*", "DATE'2024-02-03' AS date", "CAST(NULL AS STRING) AS expense_id", "CAST(NULL AS STRING) AS session_id", "CAST(NULL AS STRING) AS attachment_id")
    lines = [(1, 0, D(4), None, None), (1, 1, D(6), "L", "l2"), (2, 0, D(7), None, None), (3, 0, D(9), None, None), (4, 0, D(99), None, None), (5, 0, D(4), None, None)]
    lines = spark.createDataFrame(lines, "document_id int, line_index int, line_total decimal(18,2), category_id string, subcategory_id string")
    booked = spark.createDataFrame([("e9", "p9", None, None)], "id string, process_id string, session_id string, attachment_id string")
    cats = spark.createDataFrame([("A", None, None, 1), ("A2", "A", None, 2), ("A1", "A", None, 1), ("M", None, "CAT_MISC", 5), ("S", None, None, None)], "id string, parent_id string, code string, sort_order int")
    got = registration.register(docs, lines, booked, cats)
    # 4 is booked, the sum of 5 is off
    assert sorted((r.id, r.amount, r.category_id, r.subcategory_id) for r in got["expenses"].collect()) == [("exp-1", D(10), "S", "s1"), ("exp-2", D(7), "M", "M"), ("exp-3", D(9), "A", "A1")]
    items = [("exp-1-0", "S", "s1"), ("exp-1-1", "L", "l2"), ("exp-2-0", "M", "M"), ("exp-3-0", "A", "A1")]
    assert sorted((r.id, r.category_id, r.subcategory_id) for r in got["items"].collect()) == items
    assert sorted((r.document_id, r.line_index, r.item_id, r.expense_id) for r in got["links"].collect()) == [(1, 0, "exp-1-0", "exp-1"), (1, 1, "exp-1-1", "exp-1"), (2, 0, "exp-2-0", "exp-2"), (3, 0, "exp-3-0", "exp-3")]
