r"""Quality classifier (operator 11): naive Bayes support vectors.

The features of a text are indicators: which n-grams occur in it, hashed into 2^BITS buckets. There are three kinds of n-gram: one to three characters; one or two words; one to three word
shapes (upper case, lower case, digits, each symbol itself, runs once, and whether the word repeats the one before). Each indicator is scaled by the log-count ratio of the labels,
log((1 + documents of label 1) / all) - log((1 + documents of label 0) / all), and a linear model with hinge loss is fitted on the scaled indicators (brought to length 1, so long texts weigh as
short ones do) by dual coordinate descent. The model's weights are drawn towards their mean (`BLEND`), as naive Bayes would have them equal. A logistic curve, fitted on rows set aside,
turns margins into probabilities of label 1.

Training: a bounded sample of the labelled documents, about `sample` of each label and `entries` features in all, drawn by hash; Spark counts the documents of each bucket, the fit itself
runs on the driver on those `entries` at most. No feature is left out. Rows weigh so that both labels count alike in the fit and as in the whole table in the logistic curve.

Scoring: each task scores its own rows, whole texts. Texts of over PIECE code points are read in pieces cut at white space, and n-grams don't span a cut; the union of the pieces counts.

Defined cases: a null or empty text has no feature, its score is the model's constant; null labels, labels without an id and labels without a document are ignored, of repeated labels of a
document the lowest counts; repeated documents score alike; with one label alone every score is that label (0.0 or 1.0), without any it is 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import codes
from tallyforge.llm.common import Scratch, chunks, fold, table

BITS = 18
PIECE = 300_000
#: Bounds of the training sample: documents of each label, and features of all of them.
SAMPLE, ENTRIES = 3000, 12_000_000
#: Cost of a violated margin, share of the fitted weights against their mean, passes of the fit.
COST, BLEND, PASSES = 1.0, 0.25, 30


@dataclass(frozen=True)
class Model:
    """weight: of each bucket (ratio times fitted weight); bias: of the margin; slope, shift: of the logistic curve. constant: the score of every text, if the labels say nothing else."""

    weight: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Owners and pieces of the texts, in groups of about PIECE code points."""
    owners: list[int] = []
    group: list[str] = []
    held = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = at + PIECE
            if end < len(t):
                blank = max(t.rfind(" ", at + 1, end), t.rfind("\n", at + 1, end))
                end = blank if blank > at else end
            if held and held + min(end, len(t)) - at > PIECE:
                yield owners, group
                owners, group, held = [], [], 0
            owners.append(i)
            group.append(t[at:end])
            held += len(group[-1])
            at = end
    if group:
        yield owners, group


def _shapes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    kind = points.copy()
    kind[(points >= 97) & (points <= 122) | (points >= 0xAA)] = 97
    kind[(points >= 65) & (points <= 90)] = 65
    kind[(points >= 48) & (points <= 57)] = 48
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[start] = True
    before = np.concatenate(([0], np.cumsum(first)))  # runs cut at the first character of each word
    return codes.Runs(kind[first]).of(before[start], before[end])


def indicators(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all features of a batch, each pair once, in order."""
    found = [np.zeros(0, np.int64)]
    for owners, group in _pieces(texts):
        points, begins = codes.code_points(group)
        piece = np.repeat(np.arange(len(group)), np.diff(begins))
        owner = np.array(owners, np.int64)[piece]
        chars = codes.Runs(points)
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        edge = np.diff(np.concatenate(([0], (~blank).view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        word, of, inside = chars.of(start, end), owner[start], piece[start]
        again = np.zeros(len(word), np.uint64)
        again[1:] = (word[1:] == word[:-1]) & (inside[1:] == inside[:-1])
        shape = codes.mixed(_shapes(points, start, end)) ^ again

        def add(salt: int, hashes: np.ndarray, of: np.ndarray, whole: np.ndarray) -> None:
            bucket = (codes.mixed(hashes, salt) >> np.uint64(64 - BITS)).astype(np.int64)
            found.append(np.unique((of << BITS | bucket)[whole]))

        for n in (1, 2, 3):
            at = np.arange(max(0, len(points) - n + 1))
            add(n, chars.of(at, at + n), owner[at], piece[at] == piece[at + n - 1])
        for salt, tokens, most in ((10, word, 2), (20, shape, 3)):
            runs = codes.Runs(codes.mixed(tokens))
            for n in range(1, most + 1):
                at = np.arange(max(0, len(tokens) - n + 1))
                add(salt + n, runs.of(at, at + n), of[at], inside[at] == inside[at + n - 1])
        found[:] = [np.unique(np.concatenate(found))]
    return found[0] >> BITS, found[0] & ((1 << BITS) - 1)


def margins(model: Model, texts: list[str]) -> np.ndarray:
    owner, bucket = indicators(texts)
    size = np.bincount(owner, minlength=len(texts))
    return np.bincount(owner, model.weight[bucket], len(texts)) / np.sqrt(np.maximum(size, 1)) + model.bias


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return 1 / (1 + np.exp(-np.clip(model.slope * margins(model, texts) + model.shift, -40, 40)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches, limit=PIECE):
        owner, bucket = indicators(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("quality", "aside", "draw")), lists], names=["quality", "aside", "draw", "bucket"])


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = PASSES, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss, by dual coordinate descent: one dual variable a row, kept within 0 and the row's cost. A row's features are
    values[buckets] brought to length 1, with a constant 1 for the bias."""
    w, bias = np.zeros(len(values)), 0.0
    alpha = np.zeros(len(rows))
    length = np.array([max(float(np.sqrt(len(r))), 1.0) for r in rows])
    square = np.array([float((values[r] ** 2).sum()) for r in rows]) / length**2 + 1.0
    order = np.random.default_rng(11)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            gap = y[i] * (float(w[r] @ values[r]) / length[i] + bias) - 1.0
            new = min(max(alpha[i] - gap / square[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[r] += step * y[i] / length[i] * values[r]
                bias += step * y[i]
                alpha[i], moved = new, max(moved, abs(step) / cost[i])
        if moved < tolerance:
            break
    return w, bias


def logistic(margin: np.ndarray, label: np.ndarray, worth: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve of greatest likelihood, with targets short of 0 and 1 by the number of rows, by Newton steps. The slope is not negative."""
    ones, zeros = float(label.sum()), float((~label).sum())
    target = np.where(label, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack((margin, np.ones(len(margin))))
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        grad = x @ (worth * (p - target)) + 1e-3 * beta
        hess = (x * (worth * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(sample: pd.DataFrame, ratio: np.ndarray, share: tuple[float, float]) -> Model:
    """sample: quality, aside, bucket (a list for each document); ratio: log-count ratio of each bucket; share: of the labels 0 and 1 in the whole table."""
    label = sample["quality"].to_numpy() > 0
    aside = sample["aside"].to_numpy().astype(bool)
    for y in (False, True):  # a label with too few rows aside is judged on all its rows
        if (aside & (label == y)).sum() < 5 or (~aside & (label == y)).sum() < 5:
            aside = aside & (label != y)
    rows = [np.asarray(b, np.int64) for b in sample["bucket"]]
    own = np.flatnonzero(~aside)
    counts = np.array([(~label[own]).sum(), label[own].sum()], float)
    cost = COST * len(own) / 2 / counts[label[own].astype(int)]
    w, bias = dual_descent([rows[i] for i in own], ratio, np.where(label[own], 1.0, -1.0), cost)
    w = BLEND * w + (1 - BLEND) * float(np.abs(w).mean())
    weight = w * ratio
    judged = np.array([weight[r].sum() / max(np.sqrt(len(r)), 1.0) for r in rows]) + bias
    used = np.array([(aside & (label == y)).any() for y in (False, True)])
    rows_used = aside | ~used[label.astype(int)]
    n = np.array([(rows_used & ~label).sum(), (rows_used & label).sum()], float)
    worth = (np.array(share) / n)[label[rows_used].astype(int)] * rows_used.sum()
    slope, shift = logistic(judged[rows_used], label[rows_used], worth)
    return Model(weight.astype(np.float32), bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Learn from the labelled documents outside fold 0 of 5."""
    scratch = Scratch(docs.sparkSession, "quality-model")
    marks = labels.where("doc_id is not null and quality is not null").where(fold("doc_id", 5) != 0)
    marks = scratch.save(marks.groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).cast("int").alias("quality")), "marks")
    sizes = {r.quality: r.n for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0), constant=float(next(iter(sizes))) if sizes else 0.5)
    draw_by = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("quality") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    drawn = marks.where(draw_by(11) < share)  # about 2 * sample ids
    known = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumns({"aside": F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(4)) == 0, "draw": draw_by(13)})
    known = scratch.save(known.select("quality", "aside", "draw", "text").mapInArrow(_featured, "quality int, aside boolean, draw double, bucket array<int>"), "sample")
    total = known.agg(F.sum(F.size("bucket")).alias("n")).first().n or 0
    known = known.where(F.col("draw") < min(1.0, entries / max(total, 1)))
    n = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(np.zeros(0), constant=float(max(sizes, key=sizes.get)))
    counts = known.select("quality", F.explode("bucket").alias("bucket")).groupBy("bucket").agg(*[F.count_if(F.col("quality") == y).alias(f"n{y}") for y in (0, 1)]).toArrow().to_pandas()
    seen = np.zeros((2, 1 << BITS))
    for y in (0, 1):
        seen[y, counts["bucket"].to_numpy()] = counts[f"n{y}"].to_numpy()
    smooth = 1.0 + seen
    rate = smooth / smooth.sum(axis=1, keepdims=True)
    ratio = np.log(rate[1]) - np.log(rate[0])
    rows = known.select("quality", "aside", "bucket").toArrow().to_pandas()
    all_rows = sum(sizes.values())
    return fit(rows, ratio, (sizes[0] / all_rows, sizes[1] / all_rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, limit=PIECE):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(probabilities(shared.value, texts))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
