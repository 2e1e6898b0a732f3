"""SentencePiece encoding and decoding (operator 8) by suffix-array matching.

The distinct words of a batch are laid end to end and a suffix array of that text is built (prefix doubling up to the longest piece). Every piece of the vocabulary is
binary-searched in it at once, letter by letter; the range it ends with gives all its occurrences. Sorted by position, these occurrences are the edges of one lattice over
the batch. The lattice is then relaxed. The model file is a byte-pair model, whose encoding is defined by merges and not by a best path, so relaxing means: in every word
the neighbouring symbols whose joint edge has the best score become one symbol, the leftmost first, until no edge joins two. All words of the batch relax at the same time.
A character without a piece becomes its UTF-8 bytes. The ids are those of the sentencepiece library.

A piece never holds a blank after another character, so a text's ids are its words' ids in order and each distinct word is encoded once for each task and memory.

Defined cases: a null or empty text has no ids and decodes to the empty text; decoding restores the text, except that the mark U+2581 itself comes back as a blank; repeated
rows are encoded alike; texts of any length are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import chunks, table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Distinct words a task remembers; beyond that it forgets all and starts anew.
REMEMBERED = 500_000
#: Words of more letters are relaxed with a heap, and not remembered.
LONG_WORD = 200
#: Letters and words that are indexed at once (a longer word comes alone).
LETTERS, WORDS = 400_000, 30_000
_NONE = np.int64(1) << 40


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        self.prefix = model.normalizer_spec.add_dummy_prefix
        plain = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
        self.byte = np.zeros(256, np.int32)
        self.out = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[3:-1], 16)] = i
                self.out[i] = bytes([int(p.piece[3:-1], 16)])
            elif p.type not in (kinds.CONTROL, kinds.UNKNOWN):
                self.out[i] = p.piece.replace(BLANK, " ").encode()
        self.ids = np.asarray([i for _, i, _ in plain], np.int32)
        self.length = np.asarray([len(p) for p, _, _ in plain])
        self.longest = int(self.length.max())
        self.letters = np.zeros((len(plain), self.longest), np.int64)
        for row, (p, _, _) in enumerate(plain):
            self.letters[row, : len(p)] = [ord(c) for c in p]
        _, self.order = np.unique([-s for _, _, s in plain], return_inverse=True)
        # a blank after another character would let words merge; a line feed in a piece would let lines merge
        assert not any(BLANK in p.lstrip(BLANK) for p, _, _ in plain)
        parts = rf"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+" + (r"|\n" if not any("\n" in p for p, _, _ in plain) else "")
        self.words = re.compile(parts if parts.endswith("n") else rf"{BLANK}*[^{BLANK}]+|{BLANK}+")


@lru_cache(maxsize=2)
def load(name: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the `depth` numbers that follow them (at least)."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, order = 1, np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:] + 1
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        step *= 2
    return order


def occurrences(text: np.ndarray, order: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every occurrence of every piece, sorted by position."""
    padded = np.concatenate((text, np.zeros(v.longest + 1, np.int64)))
    low, high = np.zeros(len(v.length), np.int64), np.full(len(v.length), len(text), np.int64)
    for d in range(v.longest):
        live = np.flatnonzero((v.length > d) & (low < high))
        if not len(live):
            break
        want = v.letters[live, d]
        bounds = []
        for beyond in (False, True):
            a, b = low[live].copy(), high[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, len(order) - 1)] + d]
                right = ((seen <= want) if beyond else (seen < want)) & open_
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            bounds.append(a)
        low[live], high[live] = bounds
    count = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(count)), count)
    position = order[np.repeat(low, count) + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)]
    by_place = np.argsort(position, kind="stable")
    return position[by_place], piece[by_place]


def _merged(begin: int, end: int, best: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of one word: a heap gives the best edge, the leftmost of equal ones; each merge offers two new edges, so n letters take about n log n steps."""
    n = end - begin
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next symbol begins, and the one before
    pairs = best[begin : end - 1, 2]
    some = np.flatnonzero(pairs != _NONE)
    heap = list(zip(pairs[some].tolist(), some.tolist(), (some + 2).tolist(), strict=True))
    heapify(heap)
    while heap:
        _, i, j = heappop(heap)
        middle = right[i]
        if middle <= i or middle >= n or right[middle] != j:
            continue  # one of its symbols has been merged since
        right[i], right[middle] = j, 0
        if j < n:
            left[j] = i
        for a, b in ((left[i], j), (i, right[j] if j < n else 0)):
            if a >= 0 and 0 < b - a <= longest:
                cost = int(best[begin + a, b - a])
                if cost != _NONE:
                    heappush(heap, (cost, a, b))
    at = np.asarray([i for i in range(n) if right[i] > i], np.int64)
    return at + begin, np.append(at[1:], n) + begin


def relax(n: int, ends: np.ndarray, position: np.ndarray, piece: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (start, end) left when no edge joins two of a word. n characters; ends: the end of the word of each character."""
    best = np.full((n, v.longest + 1), _NONE, np.int64)
    best[position, v.length[piece]] = v.order[piece]
    start = np.flatnonzero(ends > np.arange(n))  # separators are no symbols
    settled = []
    # the rounds below make one merge in each word: a long word would take as many rounds as it has letters
    begin = start[np.concatenate(([True], ends[start][1:] != ends[start][:-1]))] if len(start) else start
    for b in begin[ends[begin] - begin > LONG_WORD].tolist():
        settled.append(_merged(b, int(ends[b]), best, v.longest))
    if settled:
        last = np.zeros(n, np.int64)
        last[begin] = ends[begin] - begin
        start = start[last[begin][np.searchsorted(begin, start, side="right") - 1] <= LONG_WORD]
    while len(start):
        word = ends[start]
        after = np.append(start[1:], n)
        after = np.where(np.append(word[1:] == word[:-1], False), after, word)  # end of this symbol
        joint = np.append(after[1:], n)  # end of the next one
        size = joint - start
        ok = np.append(word[1:] == word[:-1], False) & (size <= v.longest)
        cost = np.full(len(start), _NONE, np.int64)
        cost[ok] = best[start[ok], size[ok]]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(cost, first)
        group = np.cumsum(np.concatenate(([0], word[1:] != word[:-1])))
        fixed = least[group] == _NONE
        settled.append((start[fixed], after[fixed]))
        take = np.flatnonzero((cost == least[group]) & ~fixed)
        take = take[np.concatenate(([True], group[take][1:] != group[take][:-1]))] if len(take) else take  # the leftmost of a word
        keep = ~fixed
        keep[take + 1] = False
        start = start[keep]
    a = np.concatenate([s for s, _ in settled]) if settled else np.zeros(0, np.int64)
    b = np.concatenate([e for _, e in settled]) if settled else np.zeros(0, np.int64)
    by_place = np.argsort(a, kind="stable")
    return a[by_place], b[by_place]


def encode_words(words: list[str], v: Vocabulary) -> list[bytes]:
    """Ids of each word (blanks already marked) as bytes of little-endian 32-bit numbers."""
    text = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.asarray([len(w) for w in words])
    begins = np.cumsum(sizes + 1) - sizes - 1
    ends = np.repeat(begins + sizes, sizes + 1)
    position, piece = occurrences(text, suffix_array(text, v.longest), v)
    inside = position + v.length[piece] <= ends[position]
    position, piece = position[inside], piece[inside]
    a, b = relax(len(text), ends, position, piece, v)
    ids = np.full((len(text), v.longest + 1), -1, np.int32)
    ids[position, v.length[piece]] = v.ids[piece]
    found = ids[a, np.minimum(b - a, v.longest)].tolist()
    out: list[list[int]] = [[] for _ in words]
    for w, i, x in zip((np.searchsorted(begins, a, side="right") - 1).tolist(), a.tolist(), found, strict=True):
        out[w].append(x) if x >= 0 else out[w].extend(v.byte[list(chr(text[i]).encode("utf-8", "surrogatepass"))].tolist())
    return [np.asarray(x, "<i4").tobytes() for x in out]


class Encoder(dict):
    """Ids of texts; remembers the distinct words it has met."""

    def __init__(self, model: str = MODEL):
        self.v = load(model)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        prefix = BLANK if self.v.prefix else ""
        split = [self.v.words.findall(prefix + t.replace(" ", BLANK)) if t else [] for t in texts]
        fresh = list({w for words in split for w in words if w not in self})
        if fresh and len(self) > REMEMBERED:
            self.clear()
            fresh = list({w for words in split for w in words})
        group, held = [], 0
        for w in fresh:
            if group and (held + len(w) > LETTERS or len(group) == WORDS):
                self.update(zip(group, encode_words(group, self.v), strict=True))
                group, held = [], 0
            group.append(w)
            held += len(w)
        if group:
            self.update(zip(group, encode_words(group, self.v), strict=True))
        out = [np.frombuffer(b"".join(map(self.__getitem__, words)), "<i4") for words in split]
        for w in fresh:
            if len(w) > LONG_WORD:
                del self[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.v.out.__getitem__, ids.tolist()))
        return (text[1:] if self.v.prefix and text[:1] == b" " else text).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder_of(model: str) -> Encoder:
    """One for each worker process."""
    return Encoder(model)


def gathered(parts: Iterator[tuple[pa.RecordBatch, list[str]]], limit: int = 8_000_000) -> Iterator[list[tuple[pa.RecordBatch, list[str]]]]:
    """Groups of parts with about `limit` characters: every search of all pieces has a fixed cost, so it should serve many texts."""
    group, held = [], 0
    for part in parts:
        group.append(part)
        held += sum(map(len, part[1]))
        if held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
    for group in gathered(chunks(batches)):
        ids = iter(encoder.encode([t for _, texts in group for t in texts]))
        for part, texts in group:
            yield part, texts, [next(ids) for _ in texts]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for part, _, ids in _encoded(batches, encoder):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([encoder.decode(np.asarray(x or [], np.int32)) for x in part.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 and round_trip (the decoded ids give the text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for part, texts, found in _encoded(batches, encoder):
            rows = []
            for t, ids in zip(texts, found, strict=True):
                back = encoder.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
