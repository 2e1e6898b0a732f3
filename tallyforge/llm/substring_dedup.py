"""Suffix-array dedup (operator 9): every byte covered by a string of `span` bytes that also starts anywhere else is removed. Method: ranks of sampled positions.

The method dealt, prefix doubling, ranks positions by what follows them and joins ranks at growing offsets until a rank is unique or longer than the threshold. Over every byte that
moves hundreds of times the input (README has figures), so another is used: the positions ranked are samples that the text itself chooses, and ranks are hashes. The sample of a start is
the place of the least hash among the `gram`-byte strings inside its `span` bytes. Equal strings choose the same place, and a run of neighbouring starts shares it.

Rounds, each a Spark count of ranks that drops what is unique:
1. rank of a sample: its `gram` bytes. A start whose sample is unique can't repeat.
2. rank past the threshold: all bytes that the starts of a sample cover, from the first start to the end of the last one. If it occurs again, all these starts do.
3. samples left (the ends of repeats, where only some starts of a sample repeat): one member of each rank of round 2 gives its bytes, and the starts of a round-1 rank are
   compared one by one, by distance to the sample and hash of their span. A rank with very many members is compared by a Spark aggregation, others inside one sorted pass.

No step pairs documents up, and what moves is in proportion to the text.

Two thresholds, one scan of the whole text: a string of `SPAN` bytes that repeats consists of shorter ones that do. So the table is scanned for `SHORT` bytes, and only the regions that
repeat there are scanned again for `SPAN`. Of the shorter repeats, those of over 50 words count as passages (`n_passage`); the pipeline's stage removes passages.

Defined cases: a null text is empty; a text shorter than `span` loses nothing; texts of any length are scanned whole, in overlapping blocks; strings never cross documents; repeated rows
are documents of their own, so each loses whatever is long enough; a null id is an id like others; an empty table gives an empty result; other columns are ignored, whatever their names.
Hashes have 64 bits and two equal ones under one sample stand for equal bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import codes
from tallyforge.llm.common import Scratch, chunks, sweep, table, with_totals

SPAN, GRAM = 400, 128
#: Passages: runs of bytes in repeated strings of SHORT bytes (51 words of prose have as many) that hold so many whole words.
SHORT, SHORT_GRAM, WORDS = 240, 64, 51
#: Bytes scanned at once; a longer text is scanned in pieces that overlap by span - 1 bytes.
BLOCK = 1 << 21
#: Members from which a rank of round 3 is compared by an aggregation.
MANY = 2_000
_PLACE = np.uint64((1 << 24) - 1)


def samples(data: np.ndarray, bounds: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts with one sample: text, first start and last start (in data), place of the sample, its hash, hash of all bytes the starts cover. bounds: where texts begin, the end last."""
    n, window = len(data), span - gram + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    runs = codes.Runs(data)
    at = np.arange(n - gram + 1)
    least = (codes.mixed(runs.of(at, at + gram), 4) & ~_PLACE) | at.astype(np.uint64)
    size = 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if window > size:
        least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
    place = (least & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(place)]
    ok = bounds[1:][text] - np.arange(len(place)) >= span
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    first, last = first[ok[first]], last[ok[first]]
    place = place[first]
    return text[first], first, last, place, codes.mixed(runs.of(place, place + gram), 5), codes.mixed(runs.of(first, last + span), 6)


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


#: What tells parts of documents apart: id, hash of the text, and where the part begins in the text.
KEY = ["id", "mark", "at"]
KEY_TYPES = "id long, mark int, at int"


def _same_part(x: str, y: str) -> Column:
    return F.col(f"{x}.id").eqNullSafe(F.col(f"{y}.id")) & (F.col(f"{x}.mark") == F.col(f"{y}.mark")) & (F.col(f"{x}.at") == F.col(f"{y}.at"))


def scan(parts: DataFrame, span: int, gram: int) -> DataFrame:
    """Round 1's samples: id, mark, at, first (start in the part), n (starts), back (from the first start to the sample), rank1, rank2. parts: id, mark, at, raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "raw", BLOCK // 2):
            if len(raw) > 1 or len(raw[0]) <= BLOCK:
                blocks = [(0, *_joined(raw))]
            else:
                data = np.frombuffer(raw[0], np.uint8)
                blocks = [(a, data[a : a + BLOCK + span - 1], np.asarray([0, len(data[a : a + BLOCK + span - 1])])) for a in range(0, len(data), BLOCK)]
            for begin, data, bounds in blocks:
                text, first, last, place, rank1, rank2 = samples(data, bounds, span, gram)
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in KEY), pa.array((first - bounds[text] + begin).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(rank1.view(np.int64)), pa.array(rank2.view(np.int64))],
                    names=[*KEY, "first", "n", "back", "rank1", "rank2"],
                )

    return parts.mapInArrow(run, f"{KEY_TYPES}, first int, n int, back int, rank1 long, rank2 long")


MEMBER = f"rank1 long, back int, n int, lonely boolean, {KEY_TYPES}, first int, bytes binary"


def _members(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "raw", BLOCK // 2):
            rows = []
            for *key, raw, wanted in zip(*(part.column(c).to_pylist() for c in KEY), texts, part.column("wanted").to_pylist(), strict=True):
                rows += [(w["rank1"], w["back"], w["n"], w["lonely"], *key, w["first"], raw[w["first"] : w["first"] + w["n"] + span - 1]) for w in wanted]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            for a in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 1000], strict=True), kinds, strict=True)], names=["rank1", "back", "n", "lonely", *KEY, "first", "bytes"])

    return run


def _starts(table_: pa.Table, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every start of every member: its member, its number there, and a key of its rank, its distance to the sample and its bytes."""
    data, bounds = _joined(table_.column("bytes").to_pylist())
    n = table_.column("n").to_numpy().astype(np.int64)
    member = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[member] + number
    far = (table_.column("back").to_numpy().astype(np.int64)[member] - number).astype(np.uint64)
    rank = table_.column("rank1").to_numpy().view(np.uint64)[member]
    return member, number, codes.mixed(codes.mixed(codes.Runs(data).of(at, at + span), 7) ^ codes.mixed(rank + far * np.uint64(0x9E3779B97F4A7C15), 8), 9)


def _spans(table_: pa.Table, member: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """Runs of neighbouring starts as rows: id, mark, at, first, last start."""
    new = np.ones(len(member), bool)
    new[1:] = (member[1:] != member[:-1]) | (number[1:] != number[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(member))[: len(a)] - 1
    take = pa.array(member[a])
    first = table_.column("first").to_numpy().astype(np.int64)[member[a]]
    return pa.RecordBatch.from_arrays([*(table_.column(c).take(take).combine_chunks() for c in KEY), pa.array((first + number[a]).astype(np.int32)), pa.array((first + number[b]).astype(np.int32))], names=[*KEY, "first", "last"])


def _compare(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members sorted by rank1 to the starts that occur in two of them. Holds whole ranks only, a batch of them at a time."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        member, number, key = _starts(rows, span)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(order), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        again &= np.asarray(rows.column("lonely").to_pylist(), bool)[member]
        return _spans(rows, member[again], number[again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rank = batch.column("rank1").to_numpy()
            cut = int(np.searchsorted(rank, rank[-1]))  # the last rank may go on in the next batch
            if cut:
                rows = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
                for a, b in _whole_ranks(rows):
                    yield done(rows.slice(a, b - a))
            elif len(held) > 1 and held[0].column("rank1")[0].as_py() != rank[-1]:
                rows, held = pa.Table.from_batches(held[:-1]), [batch]
                yield done(rows)
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def _whole_ranks(rows: pa.Table, most: int = 1000) -> Iterator[tuple[int, int]]:
    """Slices of whole ranks of about `most` rows."""
    rank = rows.column("rank1").to_numpy()
    ends = np.append(np.flatnonzero(rank[1:] != rank[:-1]) + 1, len(rank))
    a = 0
    for i, b in enumerate(ends):
        if b - a >= most or i == len(ends) - 1:
            yield a, int(b)
            a = int(b)


def _by_start(span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = pa.Table.from_batches([batch.slice(a, 1000)])
                member, number, key = _starts(rows, span)
                take = pa.array(member)
                first = (rows.column("first").to_numpy().astype(np.int64)[member] + number).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(rows.column(c).take(take).combine_chunks() for c in ("lonely", *KEY)), pa.array(first)], names=["key", "lonely", *KEY, "first"])

    return run


def repeats(parts: DataFrame, scratch: Scratch, span: int = SPAN, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """id, mark, at, first, last: runs of starts whose span occurs anywhere else, as a saved table. parts: id, mark, at, raw."""
    # round 1
    found = scratch.save(scan(parts, span, gram), "samples")
    # counts are saved, so that the join has a plain shuffle on both sides and a hot rank is cut into several tasks
    twice = scratch.save(found.groupBy("rank1").count().where("count > 1").select("rank1"), "twice")
    again = scratch.save(found.join(twice, "rank1", "left_semi"), "again")
    scratch.drop(found)
    scratch.drop(twice)
    sweep(scratch.spark)
    # round 2
    rank, member = ["rank1", "back", "n", "rank2"], F.struct(*KEY, "first")
    ranks = scratch.save(again.groupBy(*rank).agg(F.count("*").alias("of2"), F.min(member).alias("chosen")), "ranks")
    whole = again.join(ranks.where("of2 > 1"), rank, "left_semi").select(*KEY, "first", (F.col("first") + F.col("n") - 1).alias("last"))
    # round 3: the ranks that agree with another one at the sample, if one of them at least is alone with its bytes
    chosen = ranks.select("rank1", "back", "n", "chosen.*", (F.col("of2") == 1).alias("lonely"))
    mixed = scratch.save(ranks.groupBy("rank1").agg(F.count("*").alias("ranks"), F.max(F.col("of2") == 1).alias("alone")).where("ranks > 1 and alone"), "mixed")
    left = chosen.join(mixed, "rank1")
    left = scratch.save(left.select("rank1", "back", "n", *KEY, "first", "lonely", (F.col("ranks") > many).alias("hot")), "left")
    wanted = left.groupBy(*KEY).agg(F.collect_list(F.struct("rank1", "back", "n", "first", "lonely", "hot")).alias("wanted"))
    # of repeated rows one speaks for all; texts move once for both ways of comparing
    own = scratch.save(_beside(parts, wanted, "inner").dropDuplicates(KEY), "own")
    sweep(scratch.spark)
    few = own.withColumn("wanted", F.filter("wanted", lambda w: ~w["hot"])).mapInArrow(_members(span), MEMBER)
    spans = f"{KEY_TYPES}, first int, last int"
    out = scratch.save(whole, "whole")
    out = out.unionByName(scratch.save(few.repartition("rank1").sortWithinPartitions("rank1").mapInArrow(_compare(span), spans), "compared"))
    if not left.where("hot").isEmpty():
        hot = own.withColumn("wanted", F.filter("wanted", lambda w: w["hot"])).mapInArrow(_members(span), MEMBER).mapInArrow(_by_start(span), f"key long, lonely boolean, {KEY_TYPES}, first int")
        hot = scratch.save(hot, "hot")
        hot_spans = scratch.save(with_totals(hot, ["key"], scratch, "times > 1", times=F.count("*")).where("lonely").select(*KEY, "first", F.col("first").alias("last")), "hot-spans")
        scratch.drop(hot)
        out = out.unionByName(hot_spans)
    for table_ in (again, ranks, left, own):
        scratch.drop(table_)
    sweep(scratch.spark)
    return out


def _regions(firsts: np.ndarray, lasts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by spans that start from firsts to lasts: begins and ends."""
    order = np.argsort(firsts, kind="stable")
    a, b = firsts[order], np.maximum.accumulate(lasts[order] + span)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at], b[np.append(at[1:], len(a))[: len(at)] - 1]


def _long_regions(shorter: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text the regions where a string of `span` bytes can repeat, given the repeats of `shorter` bytes, as parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "raw", BLOCK // 2):
            rows = []
            for doc_id, mark, raw, firsts, lasts in zip(part.column("id").to_pylist(), part.column("mark").to_pylist(), texts, part.column("firsts").to_pylist(), part.column("lasts").to_pylist(), strict=True):
                for a, b in zip(*_regions(np.asarray(firsts, np.int64), np.asarray(lasts, np.int64), shorter), strict=True):
                    if b - a >= span:
                        rows.append((doc_id, mark, int(a), raw[a:b]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=[*KEY, "raw"])

    return run


def _without(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, ends, -1)
    return np.frombuffer(raw, np.uint8)[np.cumsum(change[:-1]) == 0].tobytes()


def _passages(raw: bytes, begins: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """Which of the runs hold so many whole words."""
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate(([0], (~((data == 32) | ((data >= 9) & (data <= 13)))).view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return np.searchsorted(end, ends, side="right") - np.searchsorted(start, begins) >= words


def _parts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.hash(F.coalesce("text", F.lit(""))).alias("mark"), F.lit(0).alias("at"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"), *more)


def _by_text(spans: DataFrame, name: str) -> DataFrame:
    """The spans of each text as two lists."""
    return spans.groupBy("id", "mark").agg(F.collect_list("first").alias(f"{name}firsts"), F.collect_list("last").alias(f"{name}lasts")).withColumn("at", F.lit(0))


def _beside(parts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """parts with the lists of their text. The lists grow with the input: a shuffled join, whatever their size."""
    names = [f"w.{c}" for c in lists.columns if c not in KEY]
    return parts.alias("d").join(lists.hint("merge").alias("w"), _same_part("d", "w"), how).select(*[f"d.{c}" for c in parts.columns], *names)


def cut(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and n_passage: bytes in passages (see above) of so many words."""
    scratch = Scratch(docs.sparkSession, "substring")
    short = repeats(_parts(docs), scratch, SHORT, SHORT_GRAM)
    regions = scratch.save(_beside(_parts(docs), _by_text(short, ""), "inner").mapInArrow(_long_regions(SHORT, SPAN), f"{KEY_TYPES}, raw binary"), "regions")
    spans = repeats(regions, scratch)
    scratch.drop(regions)
    spans = spans.select("id", "mark", (F.col("first") + F.col("at")).alias("first"), (F.col("last") + F.col("at")).alias("last"))
    both = _beside(_beside(_parts(docs), _by_text(spans, ""), "left"), _by_text(short, "short_"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "raw"):
            rows = []
            for raw, *lists in zip(texts, *(part.column(c).to_pylist() for c in ("firsts", "lasts", "short_firsts", "short_lasts")), strict=True):
                firsts, lasts, short_firsts, short_lasts = (np.asarray(x or [], np.int64) for x in lists)
                begins, ends = _regions(firsts, lasts, SPAN)
                left = _without(raw, begins, ends)
                short_begins, short_ends = _regions(short_firsts, short_lasts, SHORT)
                passage = _passages(raw, short_begins, short_ends, words)
                rows.append((len(raw), len(raw) - len(left), len(begins), hashlib.sha256(left).hexdigest(), int((short_ends - short_begins)[passage].sum())))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents"))


def without_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with every passage of so many words or more that repeats removed from the texts, all of its occurrences (half characters at the edges go with it); n_chars, if docs has it, follows.

    A text that loses nothing stays as it is, null included.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    short = repeats(_parts(docs), scratch, SHORT, SHORT_GRAM)
    rows = _parts(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others"), F.col("text")).drop("raw")
    both = _beside(rows, _by_text(short, ""), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in chunks(batches):
            out = []
            for text, firsts, lasts in zip(*(part.column(c).to_pylist() for c in ("text", "firsts", "lasts")), strict=True):
                if firsts:
                    raw = text.encode("utf-8", "surrogatepass")
                    begins, ends = _regions(np.asarray(firsts, np.int64), np.asarray(lasts, np.int64), SHORT)
                    passage = _passages(raw, begins, ends, words)
                    text = _without(raw, begins[passage], ends[passage]).decode("utf-8", "ignore") if passage.any() else text
                out.append(text)
            yield pa.RecordBatch.from_arrays([part.column("others"), pa.array(out, pa.string())], names=["others", "text"])

    done = both.mapInArrow(run, T.StructType([both.schema["others"], T.StructField("text", T.StringType())]))
    n_chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.select(*[F.col("text") if c == "text" else n_chars.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns])
