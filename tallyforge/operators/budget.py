"""Period budget analytics: totals by status, prudential balance, category roll-up, month trend and shares.

Every fact table is read once and reduced in the map stage; what meets in a shuffle is a row for each month (or category) and task. Dimensions join after the reduction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.calendar import month_label, month_of, year_of
from tallyforge.functions.money import MONEY, js_round, share, total
from tallyforge.functions.status import is_cancelled


def in_months(df: DataFrame, date: str, start_ym: int, end_ym: int) -> DataFrame:
    """Rows of a range of months, both ends included, as a filter on the date itself: it reaches the scan and prunes partitions."""
    end = end_ym + 1
    return df.where((F.col(date) >= F.lit(f"{(start_ym - 1) // 12:04d}-{(start_ym - 1) % 12 + 1:02d}-01").cast("date")) & (F.col(date) < F.lit(f"{(end - 1) // 12:04d}-{(end - 1) % 12 + 1:02d}-01").cast("date")))


def _parts(incomes: DataFrame, expenses: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of both facts by keys, from one union: columns income, received, expense, paid, notified_planned."""
    zero = F.lit(0).cast(MONEY)
    of = lambda test: F.when(test, F.col("amount")).otherwise(zero)
    status = F.col("status")
    i = incomes.where(~is_cancelled(status)).select(*keys, F.col("amount").alias("income"), of(status == "received").alias("received"), zero.alias("expense"), zero.alias("paid"), zero.alias("notified_planned"))
    e = expenses.where(~is_cancelled(status)).select(*keys, zero.alias("income"), zero.alias("received"), F.col("amount").alias("expense"), of(status == "paid").alias("paid"), of((status == "planned") & F.col("notified")).alias("notified_planned"))
    return i.unionByName(e)


def _quota(df: DataFrame, name: str) -> DataFrame:
    return df.where("status = 'active'").agg(total("monthly_quota").alias(name))


def _balance(months: Column) -> Column:
    return F.col("received") - F.col("paid") - F.col("notified_planned") - (F.col("plan_quota") + F.col("project_quota")) * months


def monthly_summary(incomes: DataFrame, expenses: DataFrame, plans: DataFrame, projects: DataFrame) -> DataFrame:
    """A row for each month with any record: totals, savings and the prudential balance."""
    sums = _parts(incomes, expenses, ["ym"]).groupBy("ym").agg(*[total(c).alias(c) for c in ("income", "received", "expense", "paid", "notified_planned")])
    quotas = _quota(plans, "plan_quota").crossJoin(_quota(projects, "project_quota"))  # one row
    out = sums.crossJoin(F.broadcast(quotas)).withColumn("prudential", _balance(F.lit(1)))
    return out.select(
        year_of(F.col("ym")).alias("year"), month_of(F.col("ym")).alias("month"), F.col("income").cast("double").alias("total_income"), F.col("received").cast("double").alias("total_received"), F.col("expense").cast("double").alias("total_expenses"),
        F.col("paid").cast("double").alias("paid_expenses"), (F.col("income") - F.col("expense")).cast("double").alias("savings"), F.col("notified_planned").cast("double"), F.col("plan_quota").cast("double"), F.col("project_quota").cast("double"),
        F.col("prudential").cast("double"), F.greatest(F.col("prudential"), F.lit(0)).cast("double").alias("surplus"), F.greatest(-F.col("prudential"), F.lit(0)).cast("double").alias("deficit"),
    )


def period_summary(incomes: DataFrame, expenses: DataFrame, plans: DataFrame, projects: DataFrame, opening: DataFrame, start_ym: int, end_ym: int) -> DataFrame:
    """One row for a range of months, with the cover of a deficit by the reserve. opening: one row, one column `opening` (money)."""
    months = end_ym - start_ym + 1
    sums = _parts(in_months(incomes, "income_date", start_ym, end_ym), in_months(expenses, "expense_date", start_ym, end_ym), []).agg(*[total(c).alias(c) for c in ("income", "received", "expense", "paid", "notified_planned")])
    one = sums.crossJoin(_quota(plans, "plan_quota")).crossJoin(_quota(projects, "project_quota")).crossJoin(opening)
    one = one.withColumn("prudential", _balance(F.lit(months)).cast(MONEY)).withColumn("surplus", F.greatest("prudential", F.lit(0).cast(MONEY))).withColumn("deficit", F.greatest(-F.col("prudential"), F.lit(0).cast(MONEY)))
    one = one.withColumn("reserve_used", F.least("opening", "deficit"))
    return one.select(
        F.lit(start_ym).alias("start_ym"), F.lit(end_ym).alias("end_ym"), F.lit(months).alias("months"), *[F.col(c).cast("double") for c in ("income", "received", "expense", "paid", "notified_planned")], (F.col("income") - F.col("expense")).cast("double").alias("savings"),
        (F.col("plan_quota") * months).cast("double").alias("plan_total"), (F.col("project_quota") * months).cast("double").alias("project_total"), F.col("prudential").cast("double"), F.col("surplus").cast("double"), F.col("deficit").cast("double"),
        F.col("opening").cast("double"), F.col("reserve_used").cast("double"), (F.col("deficit") - F.col("reserve_used")).cast("double").alias("uncovered"), (F.col("opening") + F.col("surplus") - F.col("reserve_used")).cast("double").alias("closing"),
    )


def by_category(expenses: DataFrame, categories: DataFrame, top_level: bool = True) -> DataFrame:
    """Valid expenses by top category (or by the category itself) with their share. An unknown category keeps its id (`other` if it has none) and the name Altro."""
    sums = expenses.where(~is_cancelled(F.col("status"))).groupBy("category_id").agg(total("amount").alias("amount"), F.count("*").alias("n"))
    c = categories.select(F.col("id").alias("category_id"), "parent_id", "name")
    joined = sums.join(c, "category_id", "left")
    if top_level:
        up = categories.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
        joined = joined.join(up, "parent_id", "left")
        key, name = F.when(F.col("parent_name").isNotNull(), F.col("parent_id")).otherwise(F.col("category_id")), F.coalesce("parent_name", "name", F.lit("Altro"))
    else:
        key, name = F.col("category_id"), F.coalesce("name", F.lit("Altro"))
    grouped = joined.groupBy(F.coalesce(key, F.lit("other")).alias("category_id"), name.alias("category_name")).agg(total("amount").alias("amount"), F.sum("n").alias("movements"))
    whole = grouped.agg(total("amount").alias("whole"))
    return grouped.crossJoin(F.broadcast(whole)).select("category_id", "category_name", F.col("amount").cast("double"), "movements", share(F.col("amount"), F.col("whole"), 1).alias("percentage")).orderBy(F.desc("amount"), "category_id")


def month_trend(incomes: DataFrame, expenses: DataFrame, start_ym: int, end_ym: int) -> DataFrame:
    """A row for every month of a range, months without records included."""
    spark = incomes.sparkSession
    sums = _parts(in_months(incomes, "income_date", start_ym, end_ym), in_months(expenses, "expense_date", start_ym, end_ym), ["ym"]).groupBy("ym").agg(total("income").alias("income"), total("expense").alias("expense"))
    spine = spark.range(start_ym, end_ym + 1).select(F.col("id").cast("int").alias("ym"))
    many_years = (start_ym - 1) // 12 != (end_ym - 1) // 12
    zero = F.lit(0).cast(MONEY)
    income, expense = F.coalesce("income", zero), F.coalesce("expense", zero)
    return spine.join(sums, "ym", "left").select(year_of(F.col("ym")).alias("year"), month_of(F.col("ym")).alias("month"), month_label(F.col("ym"), F.lit(many_years)).alias("month_label"), expense.cast("double").alias("amount"), income.cast("double").alias("income_amount"), (income - expense).cast("double").alias("savings_amount")).orderBy("year", "month")


def contributor_share(incomes: DataFrame, contributors: DataFrame) -> DataFrame:
    """Received income of each contributor and its share, those without income included."""
    sums = incomes.where("status = 'received'").groupBy("contributor_id").agg(total("amount").alias("amount"))
    rows = contributors.select(F.col("id").alias("contributor_id")).join(sums, "contributor_id", "left").withColumn("amount", F.coalesce("amount", F.lit(0).cast(MONEY)))
    whole = sums.agg(total("amount").alias("whole"))
    return rows.crossJoin(F.broadcast(whole)).select("contributor_id", F.col("amount").cast("double"), share(F.col("amount"), F.col("whole"), 2).alias("percentage"))


def classification_pivot(expenses: DataFrame) -> DataFrame:
    """Valid expenses of a month by classification, as columns."""
    valid = expenses.where(~is_cancelled(F.col("status")))
    kinds = ("necessary", "voluntary", "toEvaluate")
    sums = valid.groupBy("ym").agg(*[total("amount", F.col("classification") == k).alias(k) for k in kinds], total("amount").alias("total"))
    return sums.select("ym", *[F.col(k).cast("double").alias(k.lower()) for k in kinds], F.col("total").cast("double"))


def report_ratios(incomes: DataFrame, expenses: DataFrame) -> DataFrame:
    """Ratios of each month in whole percent: expenses to income (100 at most), savings to income, classes to all expenses. 0 without a positive denominator."""
    sums = _parts(incomes, expenses, ["ym"]).groupBy("ym").agg(total("income").alias("income"), total("expense").alias("expense"))
    j = sums.join(classification_pivot(expenses).drop("total"), "ym", "left").na.fill(0.0)
    income, expense = F.col("income"), F.col("expense")
    return j.select("ym", F.least(share(expense, income, 0), F.lit(100.0)).alias("expense_ratio"), share(income - expense, income, 0).alias("savings_ratio"), *[share(F.col(k), expense, 0).alias(f"{k}_ratio") for k in ("necessary", "voluntary", "toevaluate")])


def goal_variance(incomes: DataFrame, expenses: DataFrame, goals: DataFrame) -> DataFrame:
    """Savings of a month against its goal (ym, goal): difference, percent (0 if savings are negative, uncapped), length of the bar (capped)."""
    sums = _parts(incomes, expenses, ["ym"]).groupBy("ym").agg(total("income").alias("income"), total("expense").alias("expense"))
    j = goals.join(sums, "ym", "left").withColumn("savings", F.coalesce(F.col("income") - F.col("expense"), F.lit(0)).cast(MONEY))
    percent = F.when(F.col("goal") > 0, F.greatest(js_round(F.col("savings").cast("double") / F.col("goal").cast("double") * 100.0), F.lit(0.0))).otherwise(F.lit(0.0))
    return j.select("ym", F.col("goal").cast("double"), F.col("savings").cast("double"), (F.col("savings") - F.col("goal")).cast("double").alias("variance"), percent.alias("percentage"), F.least(percent, F.lit(100.0)).alias("bar"))


def page_totals(incomes: DataFrame, expenses: DataFrame) -> DataFrame:
    """For each month: received income, valid expenses and the paid part of them."""
    i = incomes.where("status = 'received'").groupBy("ym").agg(total("amount").alias("received"))
    e = expenses.where(~is_cancelled(F.col("status"))).groupBy("ym").agg(total("amount").alias("expenses"), total("amount", F.col("status") == "paid").alias("paid"))
    return i.join(e, "ym", "full").select("ym", *[F.coalesce(c, F.lit(0).cast(MONEY)).cast("double").alias(c) for c in ("received", "expenses", "paid")])


def trend_bars(trend: DataFrame) -> DataFrame:
    """Each month's length of bar in percent of the largest amount."""
    most = trend.agg(F.max(F.greatest("amount", "income_amount")).alias("most"))
    return trend.crossJoin(F.broadcast(most)).select("year", "month", *[F.when(F.col("most") > 0, js_round(F.col(c) / F.col("most") * 100.0, 1)).otherwise(F.lit(0.0)).alias(f"{c}_bar") for c in ("amount", "income_amount")])


def project_progress(projects: DataFrame) -> DataFrame:
    """Amount still to save, monthly quota to reach it and progress in percent."""
    left = F.greatest(F.col("target_amount") - F.col("saved_amount"), F.lit(0)).cast(MONEY)
    quota = js_round(left.cast("double") / F.greatest(F.col("remaining_months"), F.lit(1)), 2)
    return projects.select("id", left.cast("double").alias("remaining"), quota.alias("monthly_quota_needed"), F.least(share(F.col("saved_amount"), F.col("target_amount"), 2), F.lit(100.0)).alias("progress"))

