"""Quality rules (operator 5): a decision list learned by sequential covering.

Statistics of every whole text (words, symbols, repeated lines, repeated three-word windows and a few ratios) are computed first. A rule is a conjunction of thresholds
on the ratios, grown greedily by information gain on labelled rows and then pruned on rows set aside; the rows it covers leave, and the next rule is grown. The list
becomes one ordered Spark conditional: the first rule that holds rejects the document, else it is kept.

Training reads statistics only, of a bounded sample of labelled documents: about `sample` rows, drawn by hash.

Defined cases: a null or empty text has no words, fails the base and is not kept; null labels and labels without a document are ignored, of repeated labels of a document
the lowest counts; without labels of both kinds the list is empty and the base decides alone; repeated documents get the same verdict; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, chunks, table

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_upper", "n_marks", "n_digits", "n_stops"]
COUNTS = [*BASE, *MORE]
SAMPLE = 20_000


def ratios(c) -> dict:  # noqa: ANN001
    """The features of the rules; c(name) gives a count, as a column or as an array. Same text for both."""
    words, lines, chars = c("n_words") + 1, c("n_lines") + 1, c("word_chars") + 1
    return {
        "words": c("n_words") * 1.0,
        "word_length": c("word_chars") / words,
        "symbols_per_word": c("n_symbols") / words,
        "dup_line_share": c("n_dup_lines") / lines,
        "repeat_share": c("n_repeat_words") / words,
        "distinct_share": c("n_distinct") / words,
        "words_per_line": c("n_words") / lines,
        "upper_share": c("n_upper") / chars,
        "marks_per_word": c("n_marks") / words,
        "digit_share": c("n_digits") / chars,
        "stops_per_word": c("n_stops") / words,
    }


def text_counts(texts: list[str]) -> np.ndarray:
    """COUNTS of each text, as rows. Words are runs without space and \\t \\n \\v \\f \\r, which is how bytes.split() cuts."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    vocabulary: dict[bytes, int] = {}
    parts, sizes = [], []
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        words = raw.split()
        parts.append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        sizes.append(len(words))
        lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        codes = np.frombuffer(raw, np.uint8)
        seen = np.bincount(codes, minlength=128)
        out[i] = (
            len(words), len(t) - int(seen[9:14].sum() + seen[32]), sum(int(seen[ord(s)]) for s in SYMBOLS), len(lines) - len(set(lines)), 0,
            len(lines), len(set(words)), int(seen[65:91].sum()), int(seen[ord("!")] + seen[ord("?")]), int(seen[48:58].sum()), int(seen[ord(".")]),
        )
    ids = np.fromiter(chain.from_iterable(parts), np.int64, sum(sizes))
    text = np.repeat(np.arange(len(texts)), sizes)
    if len(ids) >= 3:
        start = np.flatnonzero(text[2:] == text[:-2])
        n = len(vocabulary)
        if n < 1 << 21:
            key = (ids[start] * n + ids[start + 1]) * n + ids[start + 2]
        else:  # three numbers no longer fit in one
            _, pair = np.unique(ids[start] * n + ids[start + 1], return_inverse=True)
            key = pair * np.int64(n) + ids[start + 2]
        order = np.argsort(key, kind="stable")  # equal windows stand in order of their texts
        same = (key[order][1:] == key[order][:-1]) & (text[start[order]][1:] == text[start[order]][:-1])
        again = np.zeros(len(order), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[start[again] + k] = True
        out[:, COUNTS.index("n_repeat_words")] = np.bincount(text[covered], minlength=len(texts))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            counts = text_counts(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    ok = np.ones(n, bool)
    for c in rule:
        ok &= (x[c.feature] > c.threshold) if c.above else (x[c.feature] <= c.threshold)
    return ok


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4, cuts: int = 48) -> Rule:
    """Add the condition of most information gain until the rule covers bad rows only, or none gains."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p0 or not n0:
            break
        base, best = math.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for name, values in x.items():
            own, own_bad = values[inside], bad[inside]
            order = np.argsort(own, kind="stable")
            sorted_, hits = own[order], np.cumsum(own_bad[order])
            ends = np.unique(np.searchsorted(sorted_, np.unique(np.quantile(sorted_[own_bad[order]], np.linspace(0, 1, cuts))), side="right"))
            for e in ends[(ends > 0) & (ends < len(own))]:
                threshold = (sorted_[e - 1] + sorted_[e]) / 2
                if not sorted_[e - 1] <= threshold < sorted_[e]:
                    continue
                for above, p, n in ((False, hits[e - 1], e - hits[e - 1]), (True, p0 - hits[e - 1], (len(own) - e) - (p0 - hits[e - 1]))):
                    if p >= 5:
                        gain = p * (math.log2(p / (p + n)) - base)
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(threshold)), None)
            start = int(np.searchsorted(sorted_, sorted_[np.flatnonzero(own_bad[order])[0]]))
            if 0 < start:
                p, n = p0, len(own) - start - p0
                gain, threshold = p * (math.log2(p / (p + n)) - base), (sorted_[start - 1] + sorted_[start]) / 2
                if gain > best[0] and sorted_[start - 1] <= threshold < sorted_[start]:
                    best = (gain, Condition(name, True, float(threshold)), None)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds((best[1],), x, len(bad))
    return tuple(rule)


def _value(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    ok = _holds(rule, x, len(bad))
    p, n = int((ok & bad).sum()), int((ok & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: dict[str, np.ndarray], bad: np.ndarray, aside: np.ndarray, most: int = 12, precision: float = 0.85) -> list[Rule]:
    """An ordered list of rules for bad rows. aside: rows that prune and judge the rules and grow none."""
    rules: list[Rule] = []
    x, bad, aside = dict(x), bad.copy(), aside.copy()
    while len(rules) < most and (bad & ~aside).sum() >= 5:
        rule = _grow({k: v[~aside] for k, v in x.items()}, bad[~aside])
        held, held_bad = {k: v[aside] for k, v in x.items()}, bad[aside]
        while len(rule) > 1 and _value(rule[:-1], held, held_bad) >= _value(rule, held, held_bad):
            rule = rule[:-1]
        ok = _holds(rule, x, len(bad))
        p, n = int((ok & bad).sum()), int((ok & ~bad).sum())
        ph, nh = int((ok & bad & aside).sum()), int((ok & ~bad & aside).sum())
        if not rule or p < 8 or p / (p + n) < precision or (ph + nh and ph / (ph + nh) < precision - 0.1):
            break
        rules.append(rule)
        x, bad, aside = {k: v[~ok] for k, v in x.items()}, bad[~ok], aside[~ok]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: number of the first rule that holds, from 1, or null."""
    features = ratios(lambda name: F.col(name))
    out: Column | None = None
    for i, rule in enumerate(rules, 1):
        test = None
        for c in rule:
            one = features[c.feature] > c.threshold if c.above else features[c.feature] <= c.threshold
            test = one if test is None else test & one
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marks.count()
    if not n:
        return []
    drawn = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.lit(min(1.0, sample / n) * (1 << 20)))
    rows = measured.where(~base_failed()).join(F.broadcast(drawn), "doc_id").orderBy("doc_id").select(*COUNTS, "quality", (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(3)) == 0).alias("aside"))
    found = rows.toPandas()  # about `sample` rows of numbers
    if found.quality.nunique() < 2:
        return []
    return learn({k: np.asarray(v, np.float64) for k, v in ratios(lambda name: found[name].to_numpy()).items()}, found.quality.to_numpy() == 0, found.aside.to_numpy().astype(bool))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = Scratch(spark, "quality").save(measure(table(spark, sf_dir, "documents")), "counts")
    rules = train(measured, table(spark, sf_dir, "labels"))
    out = measured.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    names = F.array(*[F.lit(" and ".join(map(str, r))) for r in rules]) if rules else F.array().cast("array<string>")
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), F.when(~F.col("base_failed"), F.get(names, F.col("rule") - 1)).alias("rejected_by"))
