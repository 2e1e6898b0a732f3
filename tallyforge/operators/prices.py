"""What a product has cost before a date: statistics of its price history, joined as of the date of a receipt.

History is reduced to a row for each product and day first, requests to distinct products and days, so a product that is bought all the time is as many rows as there are days. The join
as of a date is then one window over both, ordered by day, and no range join.

`verdicts` asks the same of all products of a text at once: how many of them a price is far off from, and the first of them by id that it is near to, far off from, or says nothing about.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The ratio of a price to the mean before it that is plausible and what that adds; the ratios that are not and what they cost.
PLAUSIBLE, PLAUSIBLE_SCORE = (0.7, 1.4), 5
ANOMALOUS, ANOMALOUS_SCORE = (0.2, 3.0), -25
#: Products and questions that one task compares at once, and cells of a matrix.
PRODUCTS, QUESTIONS, CELLS = 4096, 65536, 1 << 20


def daily(history: DataFrame) -> DataFrame:
    """history (product_id, day, cents) to product_id, day, n, total, low, high. Rows without a product, day or price say nothing."""
    known = history.where("product_id is not null and day is not null and cents is not null")
    return known.groupBy("product_id", "day").agg(F.count("*").alias("n"), F.sum("cents").alias("total"), F.min("cents").alias("low"), F.max("cents").alias("high"))


def as_of(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Distinct requests (product_id, day) with n, mean, low, high (in cents) of the history strictly before the day; n is 0 and the others null without any."""
    asked = requests.select("product_id", "day").where("product_id is not null and day is not null").distinct()
    nothing = {c: F.lit(None).cast("bigint") for c in ("n", "total", "low", "high")}
    both = daily(history).withColumn("asked", F.lit(False)).unionByName(asked.withColumns({**nothing, "asked": F.lit(True)}))
    # a request comes before the history of its own day
    before = Window.partitionBy("product_id").orderBy("day", F.desc("asked")).rowsBetween(Window.unboundedPreceding, 0)
    run = both.select("product_id", "day", "asked", *[f(c).over(before).alias(c) for f, c in ((F.sum, "n"), (F.sum, "total"), (F.min, "low"), (F.max, "high"))])
    return run.where("asked").select("product_id", "day", F.coalesce("n", F.lit(0)).alias("n"), (F.col("total") / F.col("n")).alias("mean"), "low", "high")


def ratio(cents: Column, mean: Column) -> Column:
    """Price by mean; null if one is missing or the mean isn't positive."""
    return F.when(mean > 0, cents / mean)


def plausibility(price_ratio: Column) -> Column:
    """What a price adds to the score of a match: 0 if there is nothing to compare it with."""
    return F.when(price_ratio.between(*PLAUSIBLE), PLAUSIBLE_SCORE).when((price_ratio > ANOMALOUS[1]) | (price_ratio < ANOMALOUS[0]), ANOMALOUS_SCORE).otherwise(0)


def _steps(members: DataFrame, history: DataFrame) -> DataFrame:
    """members (product_id, until and more) with a row for each day before `until` from the end of which on the mean of a product is another one, and a row without a mean before all days."""
    daily_ = daily(history.join(members.select(F.col("product_id").alias("_p"), "until").hint("merge"), F.col("product_id") == F.col("_p")).where("day < until"))
    so_far = Window.partitionBy("product_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    means = daily_.select("product_id", F.unix_date("day").alias("day"), (F.sum("total").over(so_far) / F.sum("n").over(so_far)).alias("mean"))
    start = members.withColumns({"day": F.lit(-(1 << 31)).cast("int"), "mean": F.lit(float("nan"))})
    return start.unionByName(members.join(means.hint("merge"), "product_id").select(*start.columns))


def _answered(keep: int, cells: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A function of questions (id, day, cents) and steps of products of one text: the first `keep` products of each extra score for each question. `cells` of a matrix at once."""

    def first(hit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        rows, out = np.arange(len(hit)), []
        for _ in range(min(keep, hit.shape[1])):
            at = hit.argmax(axis=1)
            some = np.flatnonzero(hit[rows, at])
            out.append((some, at[some]))
            hit[rows, at] = False
        return out

    def answer(asked: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        asked, steps = asked.sort_values("day", kind="stable"), steps.sort_values("day", kind="stable")
        ids, product = np.unique(steps["product_id"].to_numpy(), return_inverse=True)
        means, days, cents = steps["mean"].to_numpy(copy=True), asked["day"].to_numpy(), asked["cents"].to_numpy().astype(float)
        means[~(means > 0)] = np.nan
        group = asked["id"].iloc[0] if len(asked) else None
        now, done, parts = np.full(len(ids), np.nan), 0, []
        size = max(1, cells // max(1, len(ids)))
        for lo in range(0, len(asked) if len(ids) else 0, size):
            some, of = np.unique(days[lo : lo + size], return_inverse=True)
            table = np.empty((len(some), len(ids)))
            for i, end in enumerate(np.searchsorted(steps["day"].to_numpy(), some, side="left")):
                now[product[done:end]] = means[done:end]  # of a product's steps the last one stays
                done = end
                table[i] = now
            with np.errstate(all="ignore"):
                by = cents[lo : lo + size, None] / table[of]
            near, far = (by >= PLAUSIBLE[0]) & (by <= PLAUSIBLE[1]), (by > ANOMALOUS[1]) | (by < ANOMALOUS[0])
            count = far.sum(axis=1)
            for extra, hit in ((PLAUSIBLE_SCORE, near), (0, ~(near | far)), (ANOMALOUS_SCORE, far.copy())):
                for k, (rows, at) in enumerate(first(hit)):
                    odd = count[rows] if extra == ANOMALOUS_SCORE and k == 0 else 0
                    parts.append((lo + rows, np.full(len(rows), extra), at, np.broadcast_to(odd, len(rows))))
        rows, extra, at, odd = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.array([], int),) * 4
        return pd.DataFrame({"id": group, "day": days[rows], "cents": asked["cents"].to_numpy()[rows], "extra": extra, "product_id": ids[at], "odd": odd})

    return answer


def verdicts(asked: DataFrame, members: DataFrame, history: DataFrame, keep: int = 2) -> DataFrame:
    """What prices say of products with one text. asked: distinct (id of a text, day, cents) without nulls; members: product_id, id of its text; history: product_id, day, cents.

    A row for each question (id, day, cents), with `odd`, the number of the text's products from whose mean before the day the price is far off, and `first`, (extra, product_id) of the `keep` products of
    least id for each extra score. Products of a text and questions about it are dealt out in parts of bounded size, so a text that many have is many tasks, and no pair leaves its task.
    """
    texts = asked.groupBy("id").agg(F.max("day").alias("until"), F.ceil(F.count("*") / QUESTIONS).cast("int").alias("slices"))
    texts = texts.join(members.groupBy("id").agg(F.ceil(F.count("*") / PRODUCTS).cast("int").alias("parts")), "id")
    cut = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    steps = _steps(members.join(texts.hint("merge"), "id").select("id", "product_id", "until", "slices", cut("parts", "product_id").alias("part")), history)
    steps = steps.select(F.col("id").alias("text"), "part", each("slices").alias("slice"), "product_id", "day", "mean")
    questions = asked.join(texts.hint("merge"), "id").select("id", each("parts").alias("part"), cut("slices", "day", "cents").alias("slice"), F.unix_date("day").alias("day"), "cents")
    kind = {f.name: f.dataType.simpleString() for f in (*members.schema, *asked.schema)}
    schema = f"id {kind['id']}, day int, cents {kind['cents']}, extra int, product_id {kind['product_id']}, odd bigint"
    rows = questions.groupBy("id", "part", "slice").cogroup(steps.groupBy("text", "part", "slice")).applyInPandas(_answered(keep, CELLS), schema)
    found = rows.groupBy("id", "day", "cents").agg(F.sum("odd").alias("odd"), F.collect_list(F.struct("extra", "product_id")).alias("first"))
    return found.withColumn("day", F.date_from_unix_date("day"))
