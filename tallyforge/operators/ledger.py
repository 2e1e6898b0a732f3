"""The reserve ledger: deposits add, coverages subtract, adjustments set, and the balance is never below 0.

A running balance with a floor is B(t) = max(b + S(t), S(t) - min of S up to t), with the opening balance b and prefix sums S, so two window sums do it and no row waits for the one before. An
adjustment begins a new segment.

A stretch of movements is therefore a function of its opening balance, b -> max(floor, b + shift), or a constant once it holds an adjustment, and such functions compose associatively.
`balances` uses that: the movements are dealt out in ranges of (ledger, order), each range is reduced to its function by itself, the few functions of a ledger are scanned in order, and
each range is finished from its opening balance. A ledger of any size is spread over all ranges it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY
from tallyforge.sources.adapters import saved

DEPOSIT, COVERAGE, ADJUSTMENT = "monthlySurplusDeposit", "deficitCoverage", "adjustment"


def _sums(movements: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """movements with _segment (adjustments so far), _sum (since the segment began) and _low (least _sum so far), within each group of `by`."""
    amount = F.col("amount").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    step = F.when(F.col("type") == DEPOSIT, amount).when(F.col("type") == COVERAGE, -amount).when(F.col("type") == ADJUSTMENT, F.greatest(amount, zero)).otherwise(zero)
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = Window.partitionBy(*by, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = movements.withColumn("_step", step).withColumn("_segment", F.coalesce(F.sum((F.col("type") == ADJUSTMENT).cast("int")).over(run), F.lit(0)))
    return out.withColumn("_sum", F.sum("_step").over(part)).withColumn("_low", F.min("_sum").over(part)).drop("_step")


def _balance(opening: Column) -> Column:
    """A segment that an adjustment begins has no opening balance."""
    b = F.when(F.col("_segment") == 0, opening).otherwise(F.lit(0))
    return (F.col("_sum") - F.least(F.col("_low"), -b)).cast(MONEY)


def dealt(movements: DataFrame, order: list[str], ledger: list[str], ranges: int) -> DataFrame:
    """movements with the sums of their range (_range) of (ledger, order)."""
    dealt_out = movements.repartitionByRange(ranges, *[F.col(c) for c in (*ledger, *order)]).withColumn("_range", F.spark_partition_id())
    return _sums(dealt_out, ["_range", *ledger], order)


def openings(ranges: DataFrame, order: list[str], ledger: list[str]) -> DataFrame:
    """_range, ledger and _opening, the balance before each range. ranges: rows of dealt()."""
    money = "decimal(28,2)"
    last = F.max_by(F.struct("_segment", "_sum", "_low"), F.struct(*order))
    each = ranges.groupBy("_range", *ledger).agg(last.alias("x"))
    each = each.select(*ledger, F.struct("_range", (F.col("x._segment") > 0).alias("fixed"), F.col("x._sum").cast(money).alias("shift"), (F.col("x._sum") - F.col("x._low")).cast(money).alias("floor")).alias("f"))
    state = f"struct<b:{money},out:array<struct<_range:int,_opening:{money}>>>"
    start = F.struct(F.lit(0).cast(money).alias("b"), F.array().cast(f"array<struct<_range:int,_opening:{money}>>").alias("out")).cast(state)

    def step(acc: Column, f: Column) -> Column:
        after = F.greatest(f["floor"], f["shift"] + F.when(f["fixed"], F.lit(0).cast(money)).otherwise(acc["b"])).cast(money)
        return F.struct(after.alias("b"), F.array_append(acc["out"], F.struct(f["_range"].alias("_range"), acc["b"].alias("_opening"))).alias("out")).cast(state)

    # a ledger has a function for each range it covers: as many as there are ranges, at most
    scanned = each.groupBy(*ledger).agg(F.aggregate(F.array_sort(F.collect_list("f")), start, step)["out"].alias("out"))
    return scanned.select(*ledger, F.explode("out").alias("o")).select(*ledger, "o.*")


def balances(movements: DataFrame, order: list[str], ledger: list[str] = (), ranges: int | None = None) -> DataFrame:
    """movements (type, amount, ...) with balance_after. order: columns that put the movements of a ledger in a unique order; ranges: as many as shuffle partitions if not given."""
    ledger = list(ledger)
    ranges = ranges or int(movements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(dealt(movements, order, ledger, ranges), "ledger")
    first = openings(rows, order, ledger).select(F.col("_range").alias("_r"), "_opening", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(ledger)])
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(ledger):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(first, same).withColumn("balance_after", _balance(F.col("_opening"))).select(*movements.columns, "balance_after")


def month_end_movements(summary: DataFrame) -> DataFrame:
    """(ym, type, amount) of each month's prudential balance: a surplus is deposited, a deficit covered, as far as the reserve goes."""
    p = F.col("prudential").cast(MONEY)
    return summary.where(p != 0).select((F.col("year") * 12 + F.col("month")).alias("ym"), F.when(p > 0, DEPOSIT).otherwise(COVERAGE).alias("type"), F.abs(p).cast(MONEY).alias("amount"))


def chained(summary: DataFrame) -> DataFrame:
    """Month after month: opening balance, movement, what the reserve covered, what it could not, closing balance. A household has a row for each month, so one window does it."""
    done = _sums(month_end_movements(summary).withColumn("_one", F.lit(0)), ["_one"], ["ym"]).withColumn("balance_after", _balance(F.lit(0)))
    opening = F.coalesce(F.lag("balance_after").over(Window.partitionBy(F.lit(0)).orderBy("ym")), F.lit(0).cast(MONEY))
    done = done.withColumn("opening", opening)
    used = F.when(F.col("type") == COVERAGE, F.least("opening", "amount")).otherwise(F.lit(0).cast(MONEY))
    missing = F.when(F.col("type") == COVERAGE, F.col("amount") - used).otherwise(F.lit(0).cast(MONEY))
    return done.select("ym", "type", F.col("amount").cast("double"), F.col("opening").cast("double"), used.cast("double").alias("used"), missing.cast("double").alias("uncovered"), F.col("balance_after").cast("double").alias("closing"))


def latest_balance(movements: DataFrame) -> DataFrame:
    """One row: the balance after the movement of the latest date, 0 without movements; of several on that date the one with the smallest id."""
    return movements.agg(F.coalesce(F.max_by("balance_after", F.struct("movement_date", -F.col("id"))), F.lit(0)).cast("double").alias("balance"))
