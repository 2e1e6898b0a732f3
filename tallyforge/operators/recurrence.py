"""Recurring expenses to planned movements, and their reconciliation with what is stored.

A definition becomes its months by sequence() and explode(), so the work is one row for each movement and needs no shuffle; the stored movements meet the wanted ones in one
outer join by (definition, month).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.calendar import due_date, frequency_months, index_of, last_month_index, month_of, year_of

DEFAULT_METHOD = "directDebit"


def _movement(ym: Column) -> list[Column]:
    due = due_date(ym, F.col("due_day"))
    return [F.col("id").alias("fixed_expense_id"), year_of(ym).alias("year"), month_of(ym).alias("month"), due.alias("expense_date"), F.col("name").alias("description"), F.col("expected_amount").alias("amount"), F.lit("planned").alias("status")]


def by_duration(fixed: DataFrame) -> DataFrame:
    """A movement for every month of each active definition with a start and a duration, whatever its frequency."""
    wanted = fixed.where("status = 'active' and start_ym is not null and duration_months > 0")
    months = wanted.withColumn("ym", F.explode(F.sequence(F.col("start_ym"), last_month_index(F.col("start_ym"), F.col("duration_months")))))
    return months.select(*_movement(F.col("ym")))


def for_months(fixed: DataFrame, first_ym: int, last_ym: int) -> DataFrame:
    """Movements of active definitions in a range of months, within their bounds and by their frequency. A definition may have start_ym / end_ym, or start_date / end_date
    instead; the phase of the frequency comes from start_date, else from January."""
    columns = set(fixed.columns)
    date = lambda c: index_of(F.col(c)) if c in columns else F.lit(None).cast("int")
    bound = lambda c: F.col(c) if c in columns else F.lit(None).cast("int")
    start, end = F.coalesce(bound("start_ym"), date("start_date")), F.coalesce(bound("end_ym"), date("end_date"))
    months = fixed.where("status = 'active'").withColumn("ym", F.explode(F.sequence(F.lit(first_ym), F.lit(last_ym))))
    step = frequency_months(F.col("frequency"))
    phase = F.when(date("start_date").isNotNull(), F.col("ym") - date("start_date")).otherwise(month_of(F.col("ym")) - 1)
    ok = (start.isNull() | (F.col("ym") >= start)) & (end.isNull() | (F.col("ym") <= end)) & (F.pmod(phase, step) == 0)
    return months.where(ok).select(*_movement(F.col("ym")))


def reconcile(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do for each (definition, month): insert, update (stored is planned and differs), delete (planned, no longer wanted), keep."""
    key = ["fixed_expense_id", "year", "month"]
    w = wanted.select(*key, F.col("amount").alias("w_amount"), F.col("description").alias("w_description"), F.col("expense_date").alias("w_date"), F.lit(True).alias("w"))
    s = stored.select(*key, F.col("amount").alias("s_amount"), F.col("description").alias("s_description"), F.col("expense_date").alias("s_date"), F.col("status").alias("s_status"))
    differs = ~(F.col("w_amount").eqNullSafe(F.col("s_amount")) & F.col("w_description").eqNullSafe(F.col("s_description")) & F.col("w_date").eqNullSafe(F.col("s_date")))
    planned = F.col("s_status") == "planned"
    action = F.when(F.col("s_status").isNull(), "insert").when(F.col("w").isNull() & planned, "delete").when(F.col("w").isNotNull() & planned & differs, "update").otherwise("keep")
    return w.join(s, key, "full").select(*key, action.alias("action"), F.coalesce("w_amount", "s_amount").cast("double").alias("amount"))


def provisions(projects: DataFrame, expenses: DataFrame, now_ym: int, selected_ym: int) -> DataFrame:
    """Expenses of a month and, for each active project with a quota whose months include it and which has no expense there, a virtual one."""
    start = F.coalesce(index_of(F.col("start_date")), F.lit(now_ym))
    target = F.coalesce(index_of(F.col("target_date")), start + F.coalesce(F.nullif("remaining_months", F.lit(0)), F.lit(1)) - 1)
    due = projects.where("status = 'active' and monthly_quota > 0").where((F.lit(selected_ym) >= F.greatest(F.lit(now_ym), start)) & (F.lit(selected_ym) <= target))
    month = expenses.where(F.col("ym") == selected_ym)
    due = due.join(month.where("project_id is not null").select(F.col("project_id").alias("id")), "id", "left_anti")
    virtual = due.select(
        F.concat(F.lit("acc-proj-"), F.col("id").cast("string"), F.lit(f"-{(selected_ym - 1) // 12}-{(selected_ym - 1) % 12 + 1}")).alias("id"), F.concat(F.lit("Accantonamento Progetto: "), F.col("name")).alias("description"),
        F.col("monthly_quota").cast("double").alias("amount"), F.lit("paid" if selected_ym <= now_ym else "planned").alias("status"), F.lit(True).alias("is_provision"),
    )
    stored = month.select(F.col("id").cast("string").alias("id"), F.lit("").alias("description"), F.col("amount").cast("double").alias("amount"), "status", F.lit(False).alias("is_provision"))
    return stored.unionByName(virtual)
