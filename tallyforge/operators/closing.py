"""Month closing, reopening and late registrations.

A month's report is a stored row; closing rewrites it from the facts. Late facts are never dropped: the months they touch are recomputed and stay final.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.calendar import closing_date
from tallyforge.functions.money import MONEY


def _due(now: str):  # noqa: ANN202
    return F.lit(now).cast("timestamp") >= closing_date(F.col("year"), F.col("month")).cast("timestamp")


def reopen(reports: DataFrame, now: str) -> DataFrame:
    """Reports closed before their month was over are provisional again."""
    early = ~_due(now) & ((F.col("status") == "final") | F.col("closed_at").isNotNull())
    return reports.withColumn("status", F.when(early, "provisional").otherwise(F.col("status"))).withColumn("closed_at", F.when(early, F.lit(None)).otherwise(F.col("closed_at")))


def close(reports: DataFrame, summary: DataFrame, now: str) -> DataFrame:
    """Reports past their closing date that aren't final become final with fresh totals. summary: year, month and the totals by the reports' names."""
    totals = [c for c in summary.columns if c not in ("year", "month")]
    fresh = summary.select("year", "month", *[F.col(c).alias(f"_{c}") for c in totals])
    expired = _due(now) & (F.col("status") != "final")
    out = reports.join(fresh, ["year", "month"], "left")
    columns = {"status": F.when(expired, "final").otherwise(F.col("status")), "closed_at": F.when(expired, F.lit(now).cast("timestamp")).otherwise(F.col("closed_at"))}
    columns |= {c: F.when(expired, F.coalesce(F.col(f"_{c}"), F.lit(0).cast(MONEY))).otherwise(F.col(c)) for c in totals}
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in reports.columns])


def run_check(reports: DataFrame, summary: DataFrame, now: str) -> DataFrame:
    """First repair, then close."""
    return close(reopen(reports, now), summary, now)


def state_intervals(history: DataFrame) -> DataFrame:
    """history (ym, at, status) as intervals (ym, since, until, status); until is null for the state that holds now. Of several states at one instant the greatest status counts, so that
    there is one. A month has few states, however many facts it has."""
    one = history.where("ym is not null and at is not null").groupBy("ym", "at").agg(F.max("status").alias("status"))
    return one.select("ym", F.col("at").alias("since"), F.lead("at").over(Window.partitionBy("ym").orderBy("at")).alias("until"), "status")


def as_of(facts: DataFrame, history: DataFrame, at: str = "at") -> DataFrame:
    """facts (ym, at, ...) with `month_status`, the state of their month when they arrived (provisional before its first one), `month_since` and `late`, whether it was final.

    An equi-join on the month with the interval as a condition: facts meet the few states of their month, not each other, so a month with a third of all facts can be split.
    """
    s = state_intervals(history).withColumnRenamed("ym", "_ym")
    inside = (F.col("ym") == F.col("_ym")) & (F.col(at) >= F.col("since")) & (F.col("until").isNull() | (F.col(at) < F.col("until")))
    status = F.coalesce("status", F.lit("provisional"))
    return facts.join(s, inside, "left").select(*[facts[c] for c in facts.columns], status.alias("month_status"), F.col("since").alias("month_since"), (status == "final").alias("late"))


def register_late(expenses: DataFrame, incoming: DataFrame, reports: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, audit) of incoming receipts (process_id, amount, expense_date, ...): those without a date, without a positive amount or already booked by process_id don't
    pass. The audit says which months were closed already."""
    known = expenses.where("process_id is not null").select("process_id").distinct()
    ok = incoming.where("expense_date is not null and amount > 0").join(known, "process_id", "left_anti").dropDuplicates(["process_id"])
    ok = ok.withColumn("year", F.year("expense_date")).withColumn("month", F.month("expense_date"))
    closed = reports.where("status = 'final'").select("year", "month", F.lit(True).alias("closed"))
    accepted = ok.join(closed, ["year", "month"], "left").withColumn("late", F.coalesce("closed", F.lit(False)) & _due(now)).drop("closed")
    audit = accepted.select(F.lit("expense").alias("entity_type"), F.col("process_id").alias("entity_id"), F.lit("create").alias("action"), F.create_map(F.lit("amount"), F.col("amount").cast("string"), F.lit("isLateRegistration"), F.col("late").cast("string")).alias("new_values"))
    return accepted, audit


def recompute(reports: DataFrame, accepted: DataFrame) -> DataFrame:
    """Reports of months that late rows touch, with the late amounts added to total_expenses and paid_expenses; they stay final."""
    late = accepted.where("late").groupBy("year", "month").agg(F.sum("amount").cast(MONEY).alias("_more"))
    more = F.coalesce("_more", F.lit(0).cast(MONEY))
    return reports.join(late, ["year", "month"], "left").select(*[(F.col(c) + more).cast(MONEY).alias(c) if c in ("total_expenses", "paid_expenses") else F.col(c) for c in reports.columns])
