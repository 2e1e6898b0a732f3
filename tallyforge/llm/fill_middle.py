r"""Fill-in-middle (operator 12): a parallel automaton scan finds where texts are cut.

One automaton over UTF-8 bytes does all the counting: its state tells how many bytes of a code point are still to come and how much of a control string (`<P>`, `<S>`, `<M>`)
has been seen; it counts finished code points and control strings. A chunk of bytes does not know the state it is entered in, so it emits a function: for each start
state the end state and the counts. Functions compose associatively, inside a chunk (a tree over groups of four bytes), over runs of chunks and over a document, and once the
composition gives each chunk its entry state, the chunk that holds a cut is selected by counts alone and only its bytes are looked at again.

A text of CHUNK bytes or fewer is a single chunk and stays where it is: an Arrow function gives its counts and cuts, the text does not leave the JVM's row. Larger texts are cut into
chunks that are dealt over all tasks; their summaries (a text of 2 GB has 65,536 of them) compose in runs of FAN, so no task holds more than FAN of them at once.

Cuts, forms and outputs follow from hashes of `1:` and the id, as `transform` says; `restore` takes the output and the form alone.

Defined cases: a null text is empty, and an empty text is plain; a null id hashes as the empty string; repeated rows give equal results; two rows with one id and different texts are
told apart by the SHA-256 of the text; an empty table gives an empty result; texts are valid UTF-8, as Spark's strings are. `transform` keeps all columns of its input and refuses
columns with the names that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, table

CHUNK, FAN = 32_768, 256
P, S, M = "<P>", "<S>", "<M>"
#: Of 100: from which on a document stays plain, and below which the suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

# The automaton. States: 0 text, 1 after `<`, 2 after `<` and a letter of a control string, 3 to 5: one to three bytes of a code point are to come.
# Byte classes: 0 other ASCII, 1 `<`, 2 `P`, `S`, `M`, 3 `>`, 4 continuation, 5 to 7 first of two to four bytes; 8 stands for no byte and 9 for the end of a text.
STATES = 6
CLASS = np.zeros(256, np.uint16)
CLASS[ord("<")], CLASS[[ord(c) for c in "PSM"]], CLASS[ord(">")] = 1, 2, 3
CLASS[0x80:0xC0], CLASS[0xC0:0xE0], CLASS[0xE0:0xF0], CLASS[0xF0:] = 4, 5, 6, 7
NOTHING, END = 8, 9
#: Bytes in a group; the functions of all groups are in tables, of 16 classes a byte.
WIDTH = 4


def _step(state: int, kind: int) -> tuple[int, int, int]:
    """End state, code points finished, control strings finished."""
    if kind >= END:
        return (state if kind > END else 0), 0, 0
    if kind == NOTHING:
        return state, 0, 0
    if kind >= 5:
        return kind - 2, 0, 0
    if kind == 4:
        return (state - 1 if state > 3 else 0), int(state <= 3), 0
    if kind == 1:
        return 1, 1, 0
    if kind == 2 and state == 1:
        return 2, 1, 0
    return 0, 1, int(kind == 3 and state == 2)


def _tables(width: int) -> np.ndarray:
    """End states, code points and control strings of all groups of `width` bytes, by class and start state."""
    out = np.zeros((3, 1, STATES), np.uint8)
    out[0] = np.arange(STATES)
    one = np.array([[_step(s, k) for s in range(STATES)] for k in range(16)], np.uint8)
    for _ in range(width):
        then = one[:, out[0]].transpose(3, 1, 0, 2).reshape(3, -1, STATES)  # the class of the last byte varies fastest
        out = np.stack((then[0], *(then[i] + out[i].repeat(16, 0) for i in (1, 2))))
    return out


STEP, GROUP = _tables(1), _tables(WIDTH)


class Scan:
    """A run of byte classes as a tree of composed functions: what the run does from each start state, and where its code points end."""

    def __init__(self, kinds: np.ndarray):
        short = -len(kinds) % WIDTH
        self.kinds = np.concatenate((kinds, np.full(short, NOTHING, np.uint16))) if short else kinds
        self.groups = self.kinds.reshape(-1, WIDTH) @ (16 ** np.arange(WIDTH)[::-1]).astype(np.uint16)
        self.levels = [GROUP[0][self.groups]]
        while len(self.levels[-1]) > 1:
            end = self.levels[-1]
            even = len(end) // 2 * 2
            self.levels.append(np.concatenate((np.take_along_axis(end[1:even:2], end[0:even:2].astype(np.intp), 1), end[even:])))

    def states(self, start: int) -> np.ndarray:
        """The state in which each group is entered: from the root down, a left child is entered as its parent, a right one as the left one ends."""
        at = np.full(min(1, len(self.groups)), start, np.uint8)
        for end in self.levels[-2::-1]:
            out = np.empty(len(end), np.uint8)
            out[0::2] = at
            out[1::2] = np.take_along_axis(end[0 : len(end) // 2 * 2 : 2], at[: len(end) // 2, None].astype(np.intp), 1)[:, 0]
            at = out
        return at

    def summary(self) -> list[list[int]]:
        """End states, code points and control strings of each start state."""
        rows = [self.states(s) for s in range(STATES)]
        end = self.levels[-1][0].tolist() if len(self.groups) else list(range(STATES))
        return [end, *([int(GROUP[i][self.groups, at].sum(dtype=np.int64)) for at in rows] for i in (1, 2))]

    def counted(self, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a run entered in this state: states of its groups, code points and control strings up to the end of each, 0 first."""
        at = self.states(state)
        return at, *(np.concatenate(([0], np.cumsum(GROUP[i][self.groups, at], dtype=np.int64))) for i in (1, 2))

    def find(self, at: np.ndarray, points: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bytes up to the end of the k-th code point, for each k above 0; at, points: from counted()."""
        group = np.minimum(np.searchsorted(points, k), len(self.groups)) - 1  # a run that has no k-th one gives no error
        state, left, place = at[group], k - points[group], group * WIDTH
        for j in range(WIDTH):
            kind = self.kinds[group * WIDTH + j]
            go = left > 0
            left, place = left - STEP[1][kind, state], place + go
            state = STEP[0][kind, state]
        return place


def classes(data: bytes) -> np.ndarray:
    return CLASS[np.frombuffer(data, np.uint8)]


def counts_and_cuts(texts: list[bytes], a: list[int], b: list[int]) -> np.ndarray:
    """For each text, as rows: code points n, control strings, and the bytes before the smaller and the larger one of a % (n + 1) and b % (n + 1). One scan of all texts, each ended by a
    class that brings the automaton back to its start."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes // WIDTH + 1))) * WIDTH
    kinds = np.full(begin[-1], END, np.uint16)
    for at, t in zip(begin, texts, strict=False):
        kinds[at : at + len(t)] = classes(t)
    scan = Scan(kinds)
    at, points, marks = scan.counted(0)
    first = begin // WIDTH
    n, before = np.diff(points[first]), points[first[:-1]]
    cuts = np.sort(np.stack((np.array(a, np.int64) % (n + 1), np.array(b, np.int64) % (n + 1))), axis=0)
    places = [np.where(k > 0, scan.find(at, points, np.where(k > 0, before + k, 1)) - begin[:-1], 0) for k in cuts] if len(texts) else [n, n]
    return np.stack((n, np.diff(marks[first]), *places), axis=1)


def _hashes(id_col: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(4)]


def _cuts_of_small() -> Column:
    """Counts and cuts of texts that are one chunk."""

    def run(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out, some = [np.zeros((0, 4), np.int64)], 1 << 20
        size = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        edges = [0, *np.flatnonzero(np.diff(size // some)) + 1, len(text)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            out.append(counts_and_cuts(text[i:j].to_pylist(), a[i:j].to_pylist(), b[i:j].to_pylist()))
        rows = np.concatenate(out)
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(4)], names=["n", "marks", "lo", "hi"])

    return F.arrow_udf(run, "struct<n:bigint,marks:bigint,lo:bigint,hi:bigint>")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Scan(classes(x)).summary() for x in batch.column("bytes").to_pylist()]
        lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("id", "mark", "chunk")] + lists, names=["id", "mark", "chunk", "end", "points", "marks"])


SUMMARY = "array<struct<at:bigint,end:array<bigint>,points:array<bigint>,marks:array<bigint>>>"


def _composed(runs: Column) -> Column:
    """The function of a row of functions in order: for each start state (end, points, marks)."""
    start = F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.struct(s.cast("long").alias("end"), F.lit(0).cast("long").alias("points"), F.lit(0).cast("long").alias("marks")))

    def after(f: Column, g: Column) -> Column:
        at = lambda s, name: F.get(g[name], s["end"].cast("int"))
        return F.transform(f, lambda s: F.struct(at(s, "end").alias("end"), (s["points"] + at(s, "points")).alias("points"), (s["marks"] + at(s, "marks")).alias("marks")))

    return F.aggregate(runs, start, after)


def _entries(runs: Column, state: Column, points: Column) -> Column:
    """For each function of a row of functions: at, the state it is entered in, the code points before it and in it."""
    kind = "struct<state:bigint,points:bigint,out:array<struct<at:bigint,state:bigint,before:bigint,own:bigint>>>"
    start = F.struct(state.alias("state"), points.alias("points"), F.array().cast("array<struct<at:bigint,state:bigint,before:bigint,own:bigint>>").alias("out")).cast(kind)

    def step(acc: Column, g: Column) -> Column:
        own = F.get(g["points"], acc["state"].cast("int"))
        entry = F.struct(g["at"].alias("at"), acc["state"].alias("state"), acc["points"].alias("before"), own.alias("own"))
        return F.struct(F.get(g["end"], acc["state"].cast("int")).alias("state"), (acc["points"] + own).alias("points"), F.array_append(acc["out"], entry).alias("out")).cast(kind)

    return F.aggregate(runs, start, step)["out"]


def _in_order(at: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct(at.alias("at"), *(F.col(c) for c in ("end", "points", "marks"))))).cast(SUMMARY)


def _large(rows: DataFrame, chunk: int, fan: int) -> DataFrame:
    """(id, mark, n, marks, cut_lo, cut_hi) of texts of several chunks, a cut being (chunk, state it is entered in, code points of it before the cut)."""
    key = ["id", "mark"]
    data = F.col("bytes")
    parts = rows.select(*key, data, F.explode(F.sequence(F.lit(0), ((F.octet_length(data) - 1) / chunk).cast("int"))).alias("chunk"))
    parts = parts.select(*key, F.col("chunk").cast("long"), F.substr(data, F.col("chunk") * chunk + 1, F.lit(chunk)).alias("bytes")).repartition(*key, "chunk")
    kind = rows.schema["id"].dataType.simpleString()
    found = parts.mapInArrow(_summaries, f"id {kind}, mark string, chunk long, end array<bigint>, points array<bigint>, marks array<bigint>")
    # a repeated row repeats its summaries; saved, as two joins read them
    found = found.groupBy(*key, "chunk").agg(*[F.first(c).alias(c) for c in ("end", "points", "marks")])
    found = Scratch(rows.sparkSession, "fill-middle").save(found, "summaries")
    runs = found.groupBy(*key, F.floor(F.col("chunk") / fan).alias("run")).agg(_in_order(F.col("chunk")).alias("chunks")).withColumn("f", _composed(F.col("chunks")))
    names = {c: F.transform("f", lambda s: s[c]) for c in ("end", "points", "marks")}  # noqa: B023  the function is called at once
    whole = runs.withColumns(names).groupBy(*key).agg(_in_order(F.col("run")).alias("runs")).withColumn("all", F.get(_composed(F.col("runs")), 0))
    hashes = _hashes("id")
    whole = whole.withColumns({"n": F.col("all.points"), "n_marks": F.col("all.marks")}).withColumns({"a": hashes[0] % (F.col("n") + 1), "b": hashes[1] % (F.col("n") + 1)})
    whole = whole.select(*key, "n", "n_marks", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), _entries(F.col("runs"), F.lit(0), F.lit(0)).alias("entries"))
    # of each cut the run that holds it, then the chunk of that run
    cuts = whole.select(*key, "n", "n_marks", "entries", F.explode(F.array(F.struct(F.lit("lo").alias("which"), F.col("lo").alias("k")), F.struct(F.lit("hi").alias("which"), F.col("hi").alias("k")))).alias("cut"))
    holds = lambda k: lambda e: (F.greatest(k, F.lit(1)) > e["before"]) & (F.greatest(k, F.lit(1)) <= e["before"] + e["own"])
    cuts = cuts.select(*key, "n", "n_marks", "cut.*", F.get(F.filter("entries", holds(F.col("cut.k"))), 0).alias("e"))
    cuts = cuts.withColumn("run", F.col("e.at"))
    same = [cuts[c].eqNullSafe(runs[c]) for c in (*key, "run")]
    inside = cuts.join(runs, same).select(cuts["id"], cuts["mark"], "n", "n_marks", "which", "k", F.get(F.filter(_entries(F.col("chunks"), F.col("e.state"), F.col("e.before")), holds(F.col("k"))), 0).alias("e"))
    place = F.struct(F.col("e.at").alias("chunk"), F.col("e.state").alias("state"), (F.col("k") - F.col("e.before")).alias("k"))
    return inside.groupBy(*key).agg(F.first("n").alias("n"), F.first("n_marks").alias("n_marks"), *[F.max(F.when(F.col("which") == w, place)).alias(f"cut_{w}") for w in ("lo", "hi")])


def _places_of_large(chunk: int) -> Column:
    """Byte offsets of the cuts: only the bytes of the chunks that hold them are scanned again."""

    def run(data: pa.Array, at: pa.Array, state: pa.Array, k: pa.Array) -> pa.Array:
        out = []
        for x, c, s, n in zip(data.to_pylist(), at.to_pylist(), state.to_pylist(), k.to_pylist(), strict=True):
            scan = Scan(classes(x))
            states, points, _ = scan.counted(s)
            out.append(c * chunk + int(scan.find(states, points, np.array([n]))[0]) if n > 0 else 0)
        return pa.array(out, pa.int64())

    return F.arrow_udf(run, "bigint")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK, fan: int = FAN
) -> DataFrame:
    """docs with n (code points), form, prefix_chars and middle_chars (null if plain), and output.

    h1 to h4 are 32-bit numbers of the SHA-256 of `1:` and the id. The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger. A text
    that is empty, holds a control string, or has h3 % 100 >= plain_from stays plain; else the form is spm (suffix, prefix, middle) if h4 % 100 < suffix_first, and psm.
    """
    clash = sorted(set(ADDED) & set(docs.columns))
    if clash:
        raise ValueError(f"columns with the names of results: {clash}")
    columns = docs.columns
    rows = docs.withColumn("_bytes", F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    h = _hashes(id_col)
    small = rows.where(F.octet_length("_bytes") <= chunk).withColumn("_c", _cuts_of_small()(F.col("_bytes"), h[0], h[1]))
    small = small.select(*columns, "_bytes", *[F.col(f"_c.{c}").alias(f"_{c}") for c in ("n", "marks", "lo", "hi")])
    large = rows.where(F.octet_length("_bytes") > chunk).withColumn("_mark", F.sha2("_bytes", 256))
    cuts = _large(large.select(F.col(id_col).alias("id"), F.col("_mark").alias("mark"), F.col("_bytes").alias("bytes")), chunk, fan)
    large = large.join(cuts, large[id_col].eqNullSafe(cuts["id"]) & (large["_mark"] == cuts["mark"]))
    piece = lambda w: F.substr(F.col("_bytes"), (F.col(f"cut_{w}.chunk") * chunk + 1).cast("int"), F.lit(chunk))
    place = lambda w: _places_of_large(chunk)(piece(w), F.col(f"cut_{w}.chunk"), F.col(f"cut_{w}.state"), F.col(f"cut_{w}.k"))
    large = large.select(*[large[c] for c in columns], "_bytes", F.col("n").alias("_n"), F.col("n_marks").alias("_marks"), place("lo").alias("_lo"), place("hi").alias("_hi"))
    done = small.unionByName(large)
    n = F.col("_n")
    plain = (n == 0) | (F.col("_marks") > 0) | (h[2] % 100 >= plain_from)
    lo, hi = F.least(h[0] % (n + 1), h[1] % (n + 1)), F.greatest(h[0] % (n + 1), h[1] % (n + 1))
    cut = lambda a, b: F.substr(F.col("_bytes"), (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = cut(F.lit(0), F.col("_lo")), cut(F.col("_lo"), F.col("_hi")), cut(F.col("_hi"), F.octet_length("_bytes"))
    mark = {c: F.lit(c).cast("binary") for c in (P, S, M)}
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    output = F.when(form == "plain", F.col("_bytes")).when(form == "spm", F.concat(mark[S], suffix, mark[P], prefix, mark[M], middle))
    output = output.otherwise(F.concat(mark[P], prefix, mark[S], suffix, mark[M], middle)).cast("string")
    return done.select(*columns, n.alias("n"), form.alias("form"), F.when(~plain, lo).alias("prefix_chars"), F.when(~plain, hi - lo).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. The control strings of the output are its own, since a text that holds one stays plain."""
    parts = F.split(output, "<[PSM]>", 4)
    return F.when(form == "plain", output).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
h AS (SELECT doc_id, text, n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b,
  CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, lo) || '<S>' || substr(text, hi + 1) || '<M>' || substr(text, lo + 1, hi - lo)
  ELSE '<S>' || substr(text, hi + 1) || '<P>' || substr(text, 1, lo) || '<M>' || substr(text, lo + 1, hi - lo) END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
