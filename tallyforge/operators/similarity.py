"""Set-similarity join of fingerprints: only pairs that can reach a score meet.

The score of two texts is round(40 T + 35 G) + bonus, with T and G the Jaccard similarities of their words and trigrams and a bonus for equal brands, units and suppliers. From the least
score that counts and the largest bonus of a class of pairs follows what the words must give, need = least - bonus - 0.5 before rounding. A pair with 40 T + 35 G >= need has T >= split or
G >= (need - 40 split) / 35, so two joins with a threshold each find all pairs:

- T >= split: texts are compared by the number of words they must share. With two or more, pairs of words are the keys, taken from the prefix (the rarest words first) in which
  two sets with that overlap must share two; with one, single words; texts of over LONG words use single words of their prefix, so that keys stay few.
- G >= a threshold, for each class: any pair; equal units; equal brands; both. The keys are the trigrams of the prefix, rarest first, with the unit or brand in the key. A class whose bonus
  is enough joins on its brand and unit alone.

Rows of one equi-join carry the sizes of their sets and bitmaps of them: bits that differ are elements that differ, so they bound T and G from above before a pair is kept.
Equal barcodes are a class of their own, and so are equal texts without words. Nothing is dropped that could reach the score; what is kept is scored exactly by the caller.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import js_round
from tallyforge.sources.adapters import saved

#: What equal words, trigrams, brands, units and suppliers are worth, and what different brands cost.
WORDS, TRIGRAMS, SAME_TEXT, BRAND, OTHER_BRAND, UNIT, SUPPLIER = 40.0, 35.0, 75.0, 15, -20, 10, 10
#: Share of common words from which on the words find a pair, and the number of words of a long text.
SPLIT, LONG = 0.15, 24
BITMAPS = 4
HASH = "bigint"


def _ranked(texts: DataFrame) -> DataFrame:
    """side, id with words and trigrams (hashes, rarest first over both sides) and bitmaps of them."""
    hashed = lambda kind: lambda g: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), g).alias("g"))
    grams = F.concat(F.transform("tokens", hashed(0)), F.transform("trigrams", hashed(1)))
    rows = texts.select("side", "id", F.explode(grams).alias("x")).select("side", "id", "x.kind", "x.g")
    often = rows.groupBy("g").agg(F.count("*").alias("n"))
    rows = rows.join(often, "g")
    bit = F.expr("shiftleft(1L, cast(pmod(g, 64) as int))")
    part = F.pmod(F.shiftright("g", 6), F.lit(BITMAPS))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "g")))), lambda x: x["g"])
    maps = [F.coalesce(F.bit_or(F.when((F.col("kind") == 1) & (part == k), bit)), F.lit(0).cast(HASH)).alias(f"m{k}") for k in range(BITMAPS)]
    return rows.groupBy("side", "id").agg(of(0).alias("words"), of(1).alias("grams"), F.coalesce(F.bit_or(F.when(F.col("kind") == 0, bit)), F.lit(0).cast(HASH)).alias("w0"), *maps)


def _shared(size: Column, partner: Column, least: float) -> Column:
    """Elements that two sets of these sizes share at least if their similarity is `least`."""
    return F.ceil((size + partner) * (least / (1 + least)) - 1e-9)


def _prefix(items: Column, shared: Column, together: int) -> Column:
    """The first elements of a set: those in which it shares `together` with any set with which it has `shared` in common."""
    return F.slice(items, 1, F.greatest(F.size(items) - shared + together, F.lit(0)).cast("int"))


def _word_keys(side: str, split: float) -> Column:
    """Hashes under which two texts with T >= split meet."""
    words, n = F.col("words"), F.size("words")
    none = F.array().cast(f"array<{HASH}>")
    short = math.floor((1 + split) / split + 1e-9)  # up to this sum of sizes one common word can do
    # one word: the sizes of both sides are in the key, so larger texts don't meet here
    partners = F.sequence(F.lit(1), short - n)
    pair_of = (lambda m: (n, m)) if side == "a" else (lambda m: (m, n))
    single = F.flatten(F.transform(partners, lambda m: F.transform(words, lambda w: F.xxhash64(F.lit("one"), w, *[x.cast("int") for x in pair_of(m)]))))
    single = F.when((n >= 1) & (n < short), single).otherwise(none)
    # two words of the prefix
    least = F.greatest(F.lit(short + 1) - n, F.ceil(n * split - 1e-9), F.lit(1))
    prefix = _prefix(words, F.greatest(_shared(n, least, split), F.lit(2)), 2)
    double = F.flatten(F.transform(prefix, lambda w, i: F.transform(F.slice(prefix, i + 2, F.greatest(F.size(prefix) - i - 1, F.lit(0))), lambda v: F.xxhash64(F.lit("two"), w, v))))
    double = F.when((n >= 2) & (n <= LONG), double).otherwise(none)
    # one of the texts is long: the long one of a meets all of b, the short ones of a meet the long ones of b
    any_partner = _prefix(words, F.greatest(F.ceil(n * split - 1e-9), F.lit(1)), 1)
    long_partner = _prefix(words, F.greatest(_shared(n, F.lit(LONG + 1), split), F.lit(1)), 1)
    can = n >= (LONG + 1) * split - 1e-9
    under = lambda name, items: F.transform(items, lambda w: F.xxhash64(F.lit(name), w))
    if side == "a":
        long = F.when(n > LONG, under("long a", any_partner)).when(can, under("long b", long_partner)).otherwise(none)
    else:
        long = F.when(n > LONG, F.concat(under("long a", any_partner), under("long b", any_partner))).when(can, under("long a", long_partner)).otherwise(none)
    return F.concat(single, double, long)


def _classes(least: float, same_supplier: bool) -> list[tuple[str, list[str], float]]:
    """Name, key columns and need of each class of pairs."""
    base = least - 0.5 - (SUPPLIER if same_supplier else 0)
    return [("any", [], base), ("unit", ["unit"], base - UNIT), ("brand", ["brand"], base - BRAND), ("both", ["brand", "unit"], base - BRAND - UNIT)]


def _one(under: Callable[..., Column]) -> Callable[[Column], Column]:
    return lambda g: under(g)


def _gram_keys(least: float, same_supplier: bool, split: float) -> Column:
    """Hashes under which two texts of a class meet by their trigrams, by the class alone, or by their barcode."""
    none = F.array().cast(f"array<{HASH}>")
    n = F.size("grams")
    keys = [F.when(F.col("barcode").isNotNull(), F.array(F.xxhash64(F.lit("barcode"), "barcode"))).otherwise(none)]
    # equal texts score SAME_TEXT even if they have no words
    keys.append(F.when(F.size("words") == 0, F.array(F.xxhash64(F.lit("same"), "grams"))).otherwise(none))
    for name, columns, need in _classes(least, same_supplier):
        threshold = (need - WORDS * split) / TRIGRAMS
        if threshold > 1:
            continue  # trigrams alone can't do it
        given = [F.col(c) for c in columns]
        under = partial(F.xxhash64, F.lit(name), *given)
        own = F.array(under()) if threshold <= 0 else F.transform(_prefix(F.col("grams"), F.greatest(F.ceil(n * threshold - 1e-9), F.lit(1)), 1), _one(under))
        applies = F.lit(True)
        for c in given:
            applies = applies & c.isNotNull()
        keys.append(F.when(applies, own).otherwise(none))
    return F.concat(*keys)


def _most(x: str, y: str) -> Column:
    """Upper bound of round(40 T + 35 G): elements that differ are as many as bits that differ at least, and as the sizes differ."""

    def bound(size: str, maps: list[str]) -> tuple[Column, Column]:
        a, b = F.col(f"{x}.{size}"), F.col(f"{y}.{size}")
        bits = sum((F.bit_count(F.col(f"{x}.{m}").bitwiseXOR(F.col(f"{y}.{m}"))) for m in maps), F.lit(0))
        apart = F.greatest(bits, F.abs(a - b))
        return apart, F.when(a + b > 0, (a + b - apart) / (a + b + apart)).otherwise(F.lit(0.0))

    w, t = bound("n_words", ["w0"])
    v, g = bound("n_grams", [f"m{k}" for k in range(BITMAPS)])
    return F.when((w == 0) & (v == 0), F.lit(SAME_TEXT)).otherwise(js_round(t * WORDS + g * TRIGRAMS))


def candidates(a: DataFrame, b: DataFrame, least: float, same_supplier: bool = False, split: float | None = None) -> DataFrame:
    """Distinct pairs (a, b) of texts that can reach the score `least`. a, b: id, tokens, trigrams, brand, unit, barcode, a row for each distinct text."""
    base = _classes(least, same_supplier)[0][2]
    if base <= 0:
        raise ValueError("any two texts reach this score: there is nothing to join by")
    split = min(SPLIT if split is None else split, base / (2 * WORDS))
    parts = ["id", "tokens", "trigrams", "brand", "unit", "barcode"]
    texts = a.select(F.lit("a").alias("side"), *parts).unionByName(b.select(F.lit("b").alias("side"), *parts))
    sets = saved(_ranked(texts).join(texts.select("side", "id", "brand", "unit", "barcode"), ["side", "id"]), "sets")

    def keyed(side: str) -> DataFrame:
        keys = F.array_distinct(F.concat(_word_keys(side, split), _gram_keys(least, same_supplier, split)))
        return sets.where(F.col("side") == side).select(
            "id", "brand", "unit", "barcode", F.size("words").alias("n_words"), F.size("grams").alias("n_grams"), "w0", *[f"m{k}" for k in range(BITMAPS)], F.explode(keys).alias("key")
        )

    x, y = keyed("a").alias("x"), keyed("b").alias("y")
    brand = F.when(F.col("x.brand") == F.col("y.brand"), BRAND).when(F.col("x.brand") != F.col("y.brand"), OTHER_BRAND).otherwise(0)
    unit = F.when(F.col("x.unit") == F.col("y.unit"), UNIT).otherwise(0)
    enough = _most("x", "y") + brand + unit + (SUPPLIER if same_supplier else 0) >= least
    barcode = F.coalesce(F.col("x.barcode") == F.col("y.barcode"), F.lit(False))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (barcode | enough)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
