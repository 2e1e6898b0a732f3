"""Language ID (operator 1): error-correcting output codes over character n-grams.

Each language has a codeword of +1/-1 bits: all distinct two-way splits for up to five languages, else a random code with well separated words. For each bit a binary
classifier over hashed n-grams of letters (regularised least squares, solved exactly) predicts on which side of the split a text lies. Decoding adds up, for each
language, the losses of the bits against its codeword, each bit weighted by how well it did for that language in training, and takes the nearest codeword; `score` is
the soft minimum over those distances and `ambiguous` marks a text whose second nearest word is almost as near.

Training uses a bounded sample: about `sample` documents in all, the same number of each language, drawn by hash of the id from documents outside fold 2 of 4. Each gives
its whole text and two short cuts of it, so that short texts are seen too. The model is bits * 2**BITS numbers, whatever the input's size.

Defined cases: a null text and one without a letter are `und` with score 0 (and not ambiguous); a null lang trains nothing; without any labelled document every text is
`und`; with one language every text with a letter is that language, score 1; repeated documents are predicted alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import codes
from tallyforge.llm.common import Scratch, chunks, fold, table

BITS = 14
ORDERS = (1, 2, 3, 4)
SAMPLE = 480
CUTS = (40, 120)
#: Documents of each language at least, as far as there are so many: with very many languages the sample grows beyond SAMPLE by these.
EACH = 8
SHARP = 4.0


@dataclass(frozen=True)
class Model:
    """languages; code (languages x bits); worth of each bit for each language; weights (2**BITS x bits) and offset of each bit."""

    languages: list[str]
    code: np.ndarray
    worth: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def codewords(n: int) -> np.ndarray:
    """A codeword of +1/-1 for each of n languages, as rows."""
    if n <= 5:
        splits = range(1, 2 ** max(n - 1, 0))
        return np.asarray([[1 if i and s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)], np.float64).reshape(n, len(splits))
    bits, best = math.ceil(10 * math.log2(n)), None
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1.0, 1.0)
        near = ((code @ code.T) - 2 * bits * np.eye(n)).max()
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket and text of every n-gram. Letters in lower case, any run of other characters as one blank; no n-gram joins two texts."""
    points, begins = codes.code_points([t.lower() for t in texts])
    letter = codes.letters(points)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    text = np.repeat(np.arange(len(texts)), np.diff(begins))[keep]
    values = np.where(letter, points, 32)[keep].astype(np.uint64)
    h = np.zeros(len(values), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(values) < n:
            return
        h = h[: len(values) - n + 1] * np.uint64(0x100000001B3) + values[n - 1 :]
        if n in ORDERS:
            whole = text[n - 1 :] == text[: len(text) - n + 1]
            yield (codes.mixed(h, n) >> np.uint64(64 - BITS)).astype(np.int64)[whole], text[: len(text) - n + 1][whole]


def _examples(languages: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            rows = []
            for t, lang, at in zip(texts, part.column("lang").to_pylist(), part.column("at").to_pylist(), strict=True):
                for piece in (t, *(t[at % max(1, len(t) - n) :][:n] for n in CUTS)):
                    found = [b for b, _ in grams([piece])]
                    if found and len(all_ := np.concatenate(found)):
                        bucket, n = np.unique(all_, return_counts=True)
                        rows.append((number[lang], bucket.astype(np.int32), (n / len(all_)).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float32()))], names=["lang", "bucket", "share"])

    return run


def fit(examples: pd.DataFrame, languages: list[str], ridge: float = 0.3) -> Model:
    code = codewords(len(languages))
    x = np.zeros((len(examples), 1 << BITS), np.float32)
    y = examples["lang"].to_numpy()
    for i, (bucket, share) in enumerate(zip(examples["bucket"], examples["share"], strict=True)):
        x[i, bucket] = share
    mean = x.mean(axis=0)
    scale = (1 / np.sqrt(mean + 1e-5)).astype(np.float32)
    x -= mean
    x *= scale
    kernel = (x @ x.T).astype(np.float64)
    target = code[y]
    middle = target.mean(axis=0)
    dual = np.linalg.solve(kernel + ridge * np.trace(kernel) / len(kernel) * np.eye(len(kernel)), target - middle)
    weights = (x.T @ dual.astype(np.float32)) * scale[:, None]
    guess = kernel @ dual + middle
    miss = np.log1p(np.exp(-SHARP * guess * target))
    worth = np.stack([1 / (0.05 + miss[y == k].mean(axis=0)) if (y == k).any() else np.ones(code.shape[1]) for k in range(len(languages))])
    worth /= worth.sum(axis=1, keepdims=True)
    return Model(languages, code, worth, np.ascontiguousarray(weights, np.float32), middle - mean @ weights)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from documents with a lang outside fold 2 of 4; None if there are none."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(fold("doc_id", 4) != 2)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return None
    languages = sorted(r.lang for r in sizes)
    each = max(EACH, sample // len(languages))
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(each / r.n))]), F.col("lang"))
    draw = F.xxhash64("doc_id", F.lit(3))
    drawn = known.where(F.pmod(draw, F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang", F.pmod(F.shiftright(draw, 20), F.lit(1 << 30)).alias("at"))
    scratch = Scratch(docs.sparkSession, "language")
    examples = scratch.save(drawn.mapInArrow(_examples(languages), "lang int, bucket array<int>, share array<float>"), "examples")
    found = examples.orderBy("lang", F.xxhash64("bucket", "share")).toArrow().to_pandas()  # about sample * 3 rows of at most 2**BITS numbers
    scratch.drop(examples)
    return fit(found, languages) if len(found) else None


def decode(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest language, score and margin of each text."""
    n, bits = len(texts), model.code.shape[1]
    if not bits:
        return np.zeros(n, np.int64), np.ones(n), np.ones(n)
    sums, total = np.zeros((n, bits)), np.zeros(n)
    for bucket, text in grams(texts):
        total += np.bincount(text, minlength=n)
        for a in range(0, len(bucket), 1 << 18):
            own = text[a : a + (1 << 18)]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sums[own[first]] += np.add.reduceat(model.weights[bucket[a : a + (1 << 18)]], first, axis=0)
    f = sums / np.maximum(total, 1)[:, None] + model.offset
    loss = np.log1p(np.exp(-SHARP * np.clip(f[:, None, :] * model.code[None], -3, 3)))
    distance = (loss * model.worth[None]).sum(axis=2) * bits
    soft = np.exp(-(distance - distance.min(axis=1, keepdims=True)))
    soft /= soft.sum(axis=1, keepdims=True)
    ranked = np.sort(soft, axis=1)
    return soft.argmax(axis=1), ranked[:, -1], ranked[:, -1] - ranked[:, -2]


def identify(docs: DataFrame, model: Model | None, doubt: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, limit=1_000_000):
            lettered = part.column("lettered").to_pylist()
            if shared.value is None:
                best, score, margin = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.ones(len(texts))
                names = ["und"]
            else:
                best, score, margin = decode(shared.value, texts)
                names = shared.value.languages
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]), pa.array([float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]), pa.array([bool(ok and m < doubt) for m, ok in zip(margin, lettered, strict=True)])],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
