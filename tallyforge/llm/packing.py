"""Best-fit packing (operator 4): exact-complement hashing over counts of lengths.

A plan needs only how many pieces have each length, and there are at most `size` lengths. So the packing is decided on a histogram that does not grow with the data:
sums of one, two and three available lengths are indexed; from the longest length down, the gap that a piece leaves is looked up and filled exactly by a single, a pair
or a triple, as many times at once as the counts allow; where no exact filling exists the longest piece that fits is added and the smaller gap is looked up again.
The plan says which ranks of a length go to which run of sequences; the pieces find their place by their rank among pieces of their length.

Ranks need no group in one task: each task numbers its own pieces of a length, and offsets of tasks are prefix sums over the (length, task) counts.

Defined cases: a null or empty text is one piece holding the end id alone; a document longer than `size` is cut into pieces of `size`, the last may be shorter; ties
and repeated rows are separate pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, chunks, table

SIZE = 2048
VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
#: Distinct words whose ids a worker remembers; beyond that it forgets all and starts anew.
REMEMBERED = 300_000
#: A run of ASCII symbols at the end of a word, after a letter or digit, is a pre-token of its own.
TAIL = re.compile("(.*[a-z0-9\xe0-\xf6\xf8-\xff])([.,;:!?&%$*#|]+)", re.S)
#: Byte-level vocabularies write a byte as itself if it is a printable Latin-1 character, else as the next character from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
LETTER_OF_BYTE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Words(dict):
    """Ids of a text, white space apart, as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in order and each word is encoded once. It also ignores case,
    so words are kept in ASCII lower case.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.model = self.tokenizer.model
        self.marks = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"\Z(?!)")

    def __missing__(self, word: str) -> bytes:
        if tail := TAIL.fullmatch(word):
            found = self[tail[1]] + self[tail[2]]
        elif word.isalpha() and (word.isascii() or (word == "".join(map(str.lower, word)) and unicodedata.is_normalized("NFC", word))):
            # nothing to normalise or split: the model itself, over the word's bytes
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(LETTER_OF_BYTE))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        else:
            found = self._whole(word)
        self[word] = found
        return found

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.marks.search(text):
            return self._whole(text)
        if len(self) > REMEMBERED:
            self.clear()
        plain = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return b"".join(map(self.__getitem__, plain.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(maxsize=1)
def words_of(vocabulary: str) -> Words:
    """One for each worker process: loading a vocabulary costs more than a small task."""
    return Words(vocabulary)


def cut(size: int, vocabulary: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = words_of(vocabulary), TaskContext.get().partitionId()
        end, seen = np.asarray([end_id], "<u4").tobytes(), np.zeros(size + 1, np.int64)
        for part, texts in chunks(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                ids = words.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), task, int(seen[n])))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return pieces


class Gaps:
    """Which lengths are to be had, and an index of the sums of one, two and three of them.

    `pair[s]` tells whether two available lengths add up to s, `triple[s]` whether three do.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.stale = True

    def index(self) -> None:
        have = (self.counts > 0).astype(np.int64)
        have[0] = 0
        self.single = have > 0
        self.pair = np.rint(fftconvolve(have, have)) > 0
        self.triple = np.rint(fftconvolve(have, self.pair.astype(np.int64))) > 0
        self.stale = False

    def fits(self, used: tuple[int, ...]) -> bool:
        return all(self.counts[x] >= used.count(x) for x in set(used))

    def two(self, head: tuple[int, ...], gap: int) -> tuple[int, int] | None:
        """Two lengths, the longer first, that fill the gap besides head."""
        if gap < 2 or not self.pair[gap]:
            return None
        longer = np.arange(gap - 1, (gap - 1) // 2, -1)
        for a in longer[self.single[longer] & self.single[gap - longer]].tolist():
            if self.fits((*head, a, gap - a)):
                return a, gap - a
        return None

    def exact(self, head: tuple[int, ...], gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap to the last place, the longest first, besides those that head takes. All combinations are looked at until one fits."""
        if self.stale:
            self.index()
        if self.single[gap] and self.fits((*head, gap)):
            return (gap,)
        if found := self.two(head, gap):
            return found
        if not self.triple[gap]:
            return None
        firsts = np.arange(gap - 2, 0, -1)
        for a in firsts[self.single[firsts] & self.pair[gap - firsts]].tolist():
            if self.fits((*head, a)) and (found := self.two((*head, a), gap - a)):
                return (a, *found)
        return None


def fftconvolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often each sum of an index of a and one of b occurs, up to the length of a."""
    size = 2 * len(a)
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[: len(a)]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences). counts[n]: pieces of length n; the last index is the size of a sequence. Uses every piece once."""
    size, counts, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    gaps = Gaps(counts)
    for longest in range(size, 0, -1):
        while counts[longest]:
            used, gap = (longest,), size - longest
            while gap:
                if found := gaps.exact(used, gap):
                    used += found
                    break
                left = counts[: gap + 1].copy()
                for x in used:
                    if x <= gap:
                        left[x] -= 1
                if not len(fit := np.flatnonzero(left > 0)):
                    break
                used += (int(fit[-1]),)
                gap -= int(fit[-1])
            times = min(int(counts[x]) // used.count(x) for x in set(used))
            for x in used:
                counts[x] -= times
                gaps.stale |= counts[x] == 0
            out.append((used, times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, place in the sequence), sorted: from that rank on, the n-th next piece of that length goes to the n-th next sequence."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in patterns:
        at = 0
        for x in used:
            rows.append((x, given.get(x, 0), sequence, at))
            given[x] = given.get(x, 0) + times
            at += x
        sequence += times
    return np.asarray(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(docs.select("doc_id", "text").mapInArrow(cut(size, vocabulary, end_id), PIECES), "pieces")
    held = scratch.save(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "held")
    counts = np.zeros(size + 1, np.int64)
    for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r.length] = r.n
    table_of_places = spark.sparkContext.broadcast(places(plan(counts)))  # a few rows for each length

    before = held.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table_of_places.value
        high = 1 << 44
        keys = rows[:, 0] * high + rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = rows[np.searchsorted(keys, length * high + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
