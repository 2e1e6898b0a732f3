"""Toxicity (operator 7): multiple-instance learning over sentences.

A document is a bag of sentences and only the bag has a label. A sentence's score is a logistic function of the words in it and of their first letters (hashed, so that
forms of a stem share evidence); a document's score is the noisy-or of its sentences, 1 - product of (1 - sentence score). The weights maximise the likelihood of the
document labels, so the training finds by itself which sentences carry the label; `sentences` gives the scores and places of those sentences.

Training: a bounded sample of the labelled documents, about `sample` of each label, is drawn by hash (so few ids that they can be broadcast). The documents in which a
feature occurs are counted by label, the features that tell the labels apart best become the model's (`features` at most), and their weights are fitted.

Defined cases: a null or empty text has no sentence and scores 0; null labels and labels without a document are ignored; of repeated labels of a document the highest
counts; repeated documents are scored alike; without both labels in the training folds every score is the share of label 1 for a text with words (0.0 if there is no label), so
nothing is called toxic on no evidence; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import codes
from tallyforge.llm.common import Scratch, chunks, fold, table

BITS = 20
#: Leading code points of a word that count as a feature each; 0 stands for the whole word.
STEMS = (0, 3, 4, 5, 6)
FEATURES = 4096
SAMPLE = 3000
#: A feature must occur in so many labelled documents at least, and its rates under the labels must differ by so many standard errors.
LEAST, ERRORS = 5, 4.0


@dataclass(frozen=True)
class Model:
    """buckets: the chosen features, sorted; weight: of each; bias: of every sentence."""

    buckets: np.ndarray
    weight: np.ndarray
    bias: float


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of a batch: buckets (a row for each stem length), sentence and text of each word; text of each sentence; where sentences begin in the batch, the end last."""
    points, begins = codes.code_points([t.lower() for t in texts])
    word = codes.letters(points)
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stop = np.isin(points, (46, 33, 63, 10))  # . ! ? and line feed
    last = np.cumsum(stop)
    sentence = last[start] - stop[start]  # sentences before this one
    runs = codes.Runs(points)
    buckets = np.empty((len(STEMS), len(start)), np.int32)
    for i, n in enumerate(STEMS):
        upto = end if n == 0 else np.minimum(start + n, end)
        buckets[i] = (codes.mixed(runs.of(start, upto), i + 1) >> np.uint64(64 - BITS)).astype(np.int32)
    kept, sentence = np.unique(sentence, return_inverse=True)
    text = np.searchsorted(begins, start, side="right") - 1
    text_of = np.zeros(len(kept), np.int64)
    text_of[sentence] = text
    ends = np.concatenate(([0], np.flatnonzero(stop) + 1))
    return buckets, sentence, text, text_of, np.stack((ends[kept], ends[kept + 1])) if len(kept) else np.zeros((2, 0), np.int64)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n)


def sentence_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each sentence, the text it is in, and where it stands in the batch."""
    buckets, sentence, _, text_of, spans = features_of(texts)
    weights = np.zeros(1 << BITS, np.float32)
    weights[model.buckets] = model.weight
    each = weights[buckets].sum(axis=0)
    raw = model.bias + _sums(sentence, each, len(text_of))
    return 1 / (1 + np.exp(-np.clip(raw, -40, 40))), text_of, spans


def noisy_or(scores: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    return np.abs(np.expm1(_sums(text_of, np.log1p(-np.minimum(scores, 1 - 1e-12)), n)))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, 1 << BITS), np.int64)
    for part, texts in chunks(batches):
        buckets, _, text, _, _ = features_of(texts)
        label = np.asarray(part.column("toxic").to_pylist(), np.int64)
        for row in buckets:
            pair = np.unique(text << BITS | row)
            np.add.at(totals, (label[pair >> BITS], pair & ((1 << BITS) - 1)), 1)
    some = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[0, some]), pa.array(totals[1, some])], names=["bucket", "n0", "n1"])


def _bags(chosen: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document: its label, how many sentences have no chosen feature, and the chosen features of the others (place of the sentence, place of the feature)."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen), dtype=np.int32)
        for part, texts in chunks(batches):
            buckets, sentence, _, text_of, _ = features_of(texts)
            found = place[buckets]
            row, col = np.nonzero(found >= 0)
            pair = np.unique(sentence[col] * np.int64(1 << 32) + found[row, col])
            of, feature = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32)
            bounds = np.searchsorted(text_of[of], np.arange(len(texts) + 1))
            total = np.bincount(text_of, minlength=len(texts))
            rows = []
            for i, y in enumerate(part.column("toxic").to_pylist()):
                own = slice(bounds[i], bounds[i + 1])
                ids, local = np.unique(of[own], return_inverse=True)
                rows.append((y, int(total[i] - len(ids)), local.astype(np.int32), feature[own]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names=["toxic", "bare", "sentence", "feature"])

    return bags


def fit(bags: pd.DataFrame, start: np.ndarray, of_label: tuple[float, float] = (1.0, 1.0), rounds: int = 250, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias of greatest likelihood of the document labels under noisy-or, by gradient steps of adapted size. start: first weights; of_label: what a document of label 0 and of label 1 counts."""
    y = bags["toxic"].to_numpy(np.float64)
    worth = np.where(y > 0, of_label[1], of_label[0]) / (np.where(y > 0, of_label[1], of_label[0]).mean())
    bare = bags["bare"].to_numpy(np.float64)
    sizes = bags["feature"].map(len).to_numpy()
    feature = np.concatenate(bags["feature"].to_list()).astype(np.int64)
    counts = bags["sentence"].map(lambda s: int(s.max()) + 1 if len(s) else 0).to_numpy()
    sentence = np.concatenate(bags["sentence"].to_list()).astype(np.int64) + np.repeat(np.cumsum(counts) - counts, sizes)
    owner = np.repeat(np.arange(len(bags)), counts)
    n = int(counts.sum())
    weight, bias = start.copy(), -8.0
    m, v = np.zeros(len(weight) + 1), np.zeros(len(weight) + 1)
    for step in range(1, rounds + 1):
        raw = bias + np.bincount(sentence, weight[feature], n)
        p, p0 = 1 / (1 + np.exp(-np.clip(raw, -40, 40))), 1 / (1 + np.exp(-bias))
        log_none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + bare * np.log1p(-p0)
        some = -np.expm1(log_none)
        pull = np.where(y > 0, np.exp(log_none) / np.maximum(some, 1e-9), -1.0) * worth  # slope of the likelihood by -log_none
        each = pull[owner] * p
        grad = np.append(-np.bincount(feature, each[sentence], len(weight)), -(each.sum() + (pull * bare).sum() * p0)) / len(bags)
        grad[:-1] += ridge * weight / len(bags)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        weight, bias = weight - move[:-1], min(bias - move[-1], -1.0)
    return weight, float(bias)


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents outside fold 0 of 5."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).cast("int").alias("toxic"))
    marks = scratch.save(marks, "marks")
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0 if not sizes.get(1) else 40.0)
    share = F.when(F.col("toxic") == 1, sample / sizes[1]).otherwise(sample / sizes[0])
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    known = scratch.save(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic"), "sample")  # about 2 * sample ids
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0 if not n1 else 40.0)
    counts = known.mapInArrow(_document_counts, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b")).where(f"a + b >= {LEAST}")
    rate = (F.col("a") + F.col("b")) / F.lit(float(n0 + n1))
    gap = F.col("b") / F.lit(float(n1)) - F.col("a") / F.lit(float(n0))
    log_odds = F.log((F.col("b") + 0.5) / (n1 + 1.0)) - F.log((F.col("a") + 0.5) / (n0 + 1.0))
    apart = gap / F.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1) + 1e-12)
    best = counts.where(apart > ERRORS).select("bucket", log_odds.alias("w"), (gap * gap / (rate * (1 - rate) + 1e-9)).alias("s")).orderBy(F.desc("s"), "bucket").limit(features).collect()
    best = sorted((r.bucket, r.w) for r in best)
    chosen = np.asarray([b for b, _ in best], np.int64)
    bags = known.mapInArrow(_bags(chosen), "toxic int, bare long, sentence array<int>, feature array<int>").toArrow().to_pandas()
    scratch.drop(known)
    start = np.asarray([min(max(w, 0.0), 4.0) for _, w in best]) / len(STEMS)
    # each label weighs as it does in the whole table
    weight, bias = fit(bags, start, (sizes[0] / n0, sizes[1] / n1))
    return Model(chosen, weight, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, worst (the largest sentence score) and its sentence of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # `features` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            scores, text_of, spans = sentence_scores(shared.value, texts)
            whole = np.clip(noisy_or(scores, text_of, len(texts)), 0.0, 1.0)
            order = np.lexsort((scores, text_of))
            top = np.full(len(texts), -1, np.int64)
            top[text_of[order]] = order  # the last one of each text has its largest score
            begins = np.cumsum([0, *(len(t.lower()) + 1 for t in texts)])
            worst, sentence = [], []
            for i, (t, k) in enumerate(zip(texts, top, strict=True)):
                worst.append(float(scores[k]) if k >= 0 else None)
                a, b = (spans[0, k] - begins[i], spans[1, k] - begins[i]) if k >= 0 else (0, 0)
                if k >= 0 and len(t) != len(t.lower()):  # places in the lower case, back to those in the text
                    ends = np.cumsum([0, *(len(c.lower()) for c in t)])
                    a, b = (int(np.searchsorted(ends, max(x, 0), side="right")) - 1 for x in (a, b))
                sentence.append(t[max(a, 0) : b].strip() if k >= 0 else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(whole), pa.array(worst, pa.float64()), pa.array(sentence, pa.string())], names=["doc_id", "score", "worst", "sentence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, worst double, sentence string")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("worst").alias("worst_sentence_score"), F.col("sentence").alias("worst_sentence"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below 0.5, all columns as they are. Nothing moves: each task scores and filters its own rows."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            scores, text_of, _ = sentence_scores(shared.value, texts)
            yield part.filter(pa.array(noisy_or(scores, text_of, len(texts)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
