"""MinHash near-dedup with tensored banding (operator 10).

A document is the set of its five-word shingles (64-bit hashes of the words). Documents with the same set are one class from the start. Each class has two small
collections of `side` half keys, a half key being `rows` minimum hashes; a table key is a pair of half keys, one of each collection, so side * side tables come from
2 * side * rows minimum hashes, about the square root of what as many independent tables would take. Half keys that only one class has are left out before. With side 10 and rows 2, two sets of similarity 0.75 meet in no
table with a chance of 0.0005.

Classes that meet are candidates. A table cell with few classes gives all its pairs, a larger one first gives links to its smallest class and between neighbours in order (so
a cell of n classes gives fewer than 2 n pairs). Candidates are confirmed on the full sets; confirmed links are joined into components. Then cells that still hold
several components are compared again through one class of each, in the same way, until a round confirms no link. Pairs already compared are not compared again.

These rounds bring large groups together at a cost in proportion to the cells, but leave pairs of large cells out. So at last every pair of classes in different
components of a large cell is decided (`_left_over`): by an exact prefix filter, which drops only pairs that can't reach the threshold, and by comparing the full sets of all others.
Pairs within a component can't change it and are not compared.

Most candidates are ruled out before texts move, by two bounds that never drop a link (`possible`): sizes, and the parities of the sets (an odd sketch).

Large cells and hubs of components are combined in each task before they shuffle and joined with adaptive splitting (`with_totals`), large classes are reduced in salted parts, so no task
reads a whole one.

Defined cases: a null or empty text and one without words have an empty set and are linked with nothing (component: its own id); fewer than five words make one shingle
of them all; repeated rows (same id) have the same set and are one class, so each gets the same row; a null id belongs to no component (null) and is kept; ties take the
smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import codes
from tallyforge.llm.common import Scratch, chunks, sweep, table, with_totals

SHINGLE = 5
SIDE, ROWS = 10, 2
SMALL_CELL = 6
SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, size=2 * SIDE * ROWS, dtype=np.uint64) | np.uint64(1)
SALTS = 32
#: Parities kept of each set.
BITS = 1024
#: Rows of a group that are joined at once.
BLOCK = 1000


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, and where each text's hashes begin (the end last). Bytes A-Z count as a-z."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # lower() of bytes changes A-Z alone
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = codes.mixed(codes.Runs(data).of(start, end), 1)
    text = np.searchsorted(begins, start, side="right") - 1
    sizes = np.bincount(text, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    runs = codes.Runs(words)
    at = np.flatnonzero(np.arange(len(words)) - first[text] <= sizes[text] - width)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    owner = np.concatenate((text[at], short))
    values = codes.mixed(np.concatenate((runs.of(at, at + width), runs.of(first[short], first[short] + sizes[short]))), 2)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[fresh], values[fresh]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def half_keys(values: np.ndarray, bounds: np.ndarray, side: int = SIDE, rows: int = ROWS) -> np.ndarray:
    """Half keys of each set, as rows of 2 * side numbers; an empty set has zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, 2 * side), np.uint64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return out
    for k in range(2 * side):
        key = np.full(len(full), k, np.uint64)
        for r in range(rows):
            h = (values ^ SEEDS[k * rows + r]) * SEEDS[(k * rows + r + 1) % len(SEEDS)]
            h ^= h >> np.uint64(29)
            key = codes.mixed(key * np.uint64(0x100000001B3) + np.minimum.reduceat(h, bounds[full]), 3)
        out[full, k] = key
    return out


def parities(values: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> np.ndarray:
    """A row of `bits` parities for each set, as 64-bit numbers: every shingle flips one of them. Two sets differ in at least as many shingles as their parities differ in bits."""
    n, out = len(bounds) - 1, []
    place = (codes.mixed(values, 10) % np.uint64(bits)).astype(np.int64)
    for a in range(0, n, 1000):
        b = min(a + 1000, n)
        own = slice(bounds[a], bounds[b])
        owner = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        odd = (np.bincount(owner * bits + place[own], minlength=(b - a) * bits) & 1).astype(np.uint8)
        out.append(np.packbits(odd.reshape(b - a, bits), axis=1).view(np.int64))
    return np.concatenate(out) if out else np.zeros((0, bits // 64), np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.view(np.int64).ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def describe(docs: DataFrame) -> DataFrame:
    """id, n_shingles, two 64-bit fingerprints of the set, the half keys, and the parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            values, bounds = shingles(texts)
            keys = half_keys(values, bounds)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
            more = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes.mixed(values, 9))))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(bounds)), *(pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in (sums, more)), _lists(keys), _lists(parities(values, bounds))],
                names=["id", "n_shingles", "print1", "print2", "keys", "odd"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n_shingles long, print1 long, print2 long, keys array<long>, odd array<long>")


def _sized(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """Cells with two members at least: key, id, size, least (the smallest id)."""
    return with_totals(cells, ["key"], scratch, "size > 1", size=F.count("*"), least=F.min("id"))


def _pairs(cells: DataFrame) -> DataFrame:
    """(a, b), a < b, of cells (key, id, size, least): all pairs of a small cell, links to the smallest and to neighbours in a large one. Distinct."""
    small = cells.where(F.col("size") <= SMALL_CELL).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).where("size(ids) > 1")
    first = small.select("ids", F.explode(F.sequence(F.lit(0), F.size("ids") - 2)).alias("i")).select(F.get("ids", F.col("i")).alias("a"), F.explode(F.slice("ids", F.col("i") + 2, F.lit(SMALL_CELL))).alias("b"))
    large = cells.where(F.col("size") > SMALL_CELL)
    star = large.where("id > least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    # neighbours in order of id within one of SALTS parts of a cell: no task sorts a whole large cell
    part = Window.partitionBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    chain = large.select(F.lag("id").over(part).alias("a"), F.col("id").alias("b")).where("a is not null and a < b")
    return first.unionByName(star).unionByName(chain).distinct()


def _in_parts(count: str) -> Column:
    """In how many parts a group of so many rows is joined."""
    return F.ceil(F.col(count) / BLOCK).cast("int")


def _left_over(docs: DataFrame, cells: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: all pairs of ids of different components that can reach a similarity of 3/4, among the ids of cells with several components. docs: id, text; cells: key, id.

    Sets x and y of n and m shingles reach it only with 3/7 (n + m) in common. With the shingles of each set in one order for all (rare ones first), the first common one then
    stands at a place p of x (from 0) with n - p >= 3/7 (n + m), so 4 n - 7 p >= 3 m, and likewise in y. `spare` is 4 n - 7 p; as m >= 3/4 n, p is n / 4 at most.
    Components meet by shingle before their members do, so a group of one component makes no pairs; shingles of many components and large components are joined in blocks.
    """
    rooted = cells.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")) if roots is not None else cells.select("key", "id", F.col("id").alias("root"))
    lo_hi = {"lo": F.min("root"), "hi": F.max("root")}
    rooted = scratch.save(rooted, "rooted")
    mixed = scratch.save(with_totals(rooted, ["key"], scratch, "lo < hi", **lo_hi).select("id", "root").distinct(), "mixed")
    scratch.drop(rooted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            values, bounds = shingles(texts)
            n = np.diff(bounds)
            ids, root = (np.repeat(part.column(c).to_numpy(), n) for c in ("id", "root"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root), pa.array(np.repeat(n, n)), pa.array(values.view(np.int64))], names=["id", "root", "n", "shingle"])

    sets = scratch.save(docs.join(mixed, "id").select("id", "root", "text").mapInArrow(run, "id long, root long, n long, shingle long"), "sets")
    counted = with_totals(sets, ["shingle"], scratch, found=F.count("*"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("found", "shingle")) - 1
    heads = counted.withColumn("p", place).where("p <= n / 4 and found > 1").select("shingle", "id", "root", "n", (4 * F.col("n") - 7 * F.col("p")).alias("spare"))
    heads = scratch.save(heads, "heads")
    scratch.drop(sets)
    mixed_heads = scratch.save(with_totals(heads, ["shingle"], scratch, "lo < hi", **lo_hi).drop("lo", "hi"), "mixed-heads")
    scratch.drop(heads)
    members = scratch.save(with_totals(mixed_heads, ["shingle", "root"], scratch, size=F.count("*"), most=F.max("spare"), fewest=F.min("n")), "members")
    scratch.drop(mixed_heads)

    groups = scratch.save(members.select("shingle", "root", "size", "most", "fewest").distinct(), "groups")
    groups = with_totals(groups, ["shingle"], scratch, groups=F.count("*"))
    one = groups.select("shingle", F.pmod(F.xxhash64("root"), _in_parts("groups")).alias("block"), F.col("root").alias("r"), F.col("size").alias("r_size"), F.col("most").alias("r_most"), F.col("fewest").alias("r_fewest"))
    two = groups.select("shingle", F.explode(F.sequence(F.lit(0), _in_parts("groups") - 1)).alias("block"), F.col("root").alias("t"), F.col("size").alias("t_size"), F.col("most").alias("t_most"), F.col("fewest").alias("t_fewest"))
    meet = one.join(two, ["shingle", "block"]).where("r < t and r_most >= 3 * t_fewest and t_most >= 3 * r_fewest").drop("block")
    for c, x in (("r", "a"), ("t", "b")):
        side = members.select("shingle", F.col("root").alias(c), F.pmod(F.xxhash64("id"), _in_parts("size")).alias("block"), F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("spare").alias(f"{x}_spare"))
        one_block = meet.where(F.col(f"{c}_size") <= BLOCK).withColumn("block", F.lit(0))
        blocks = meet.where(F.col(f"{c}_size") > BLOCK).withColumn("block", F.explode(F.sequence(F.lit(0), _in_parts(f"{c}_size") - 1)))
        meet = one_block.unionByName(blocks).join(side, ["shingle", c, "block"]).drop("block")
        meet = meet.where("a_spare >= 3 * t_fewest and t_most >= 3 * a_n" if x == "a" else "a_spare >= 3 * b_n and b_spare >= 3 * a_n")
    return meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def possible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs that can reach a similarity of 3/4, by bounds that never drop one that does. facts: id, n, odd.

    Sets of n and m shingles with that similarity differ in (n + m) / 7 shingles at most, so their sizes are within a factor 3/4 and their parities differ in no more bits than that.
    """
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("odd").alias(f"{side}_odd")), side)
    differ = F.aggregate(F.zip_with("a_odd", "b_odd", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    return pairs.where("4 * least(a_n, b_n) >= 3 * greatest(a_n, b_n)").where(7 * differ <= F.col("a_n") + F.col("b_n")).select("a", "b")


def confirm(docs: DataFrame, pairs: DataFrame, facts: DataFrame, scratch: Scratch, least: int = 75) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= least * union (least: 75 or more). docs: id (once each), text; facts: id, n, odd."""
    pairs = scratch.save(possible(pairs, facts), "possible")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    found = scratch.save(docs.join(wanted, "id"), "wanted")
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(found.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, xs in chunks(batches, "x", 1_000_000):
            values, bounds = shingles(xs + [y or "" for y in part.column("y").to_pylist()])
            ok, n = [], len(xs)
            for i in range(n):
                p, q = values[bounds[i] : bounds[i + 1]], values[bounds[n + i] : bounds[n + i + 1]]
                common = len(np.intersect1d(p, q, assume_unique=True)) if 4 * min(len(p), len(q)) >= 3 * max(len(p), len(q)) else 0  # else it can't reach 3/4
                ok.append(common > 0 and 100 * common >= least * (len(p) + len(q) - common))
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = scratch.save(both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), "links")
    scratch.drop(found)
    scratch.drop(pairs)
    return links


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of every id in links; root: the smallest id that can be reached. Alternates two steps until nothing changes: every larger neighbour of an id moves to the
    smallest of its neighbourhood; every smaller neighbour does."""
    edges = scratch.save(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    last = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = with_totals(both, ["a"], scratch, m=F.min("b")).withColumn("m", F.least("a", "m"))
        large = scratch.save(seen.where("b > a or m < a").select(F.col("m").alias("a"), F.when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b")).where("a < b").distinct(), "large")
        back = with_totals(large.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a"], scratch, m=F.min("b"))
        small = back.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        new = scratch.save(small, "small")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        stable, last = now == last, now  # the same edges as a round before
        scratch.drop(large)
        scratch.drop(edges)
        edges = new
        if stable:
            return scratch.save(edges.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("root"))).distinct(), "roots")


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    rows = scratch.save(describe(docs), "rows")

    # classes of equal sets: half keys go with the class's smallest id. A salt reduces a large class before it meets.
    mark = ["n_shingles", "print1", "print2"]
    full = rows.where("n_shingles > 0 and id is not null")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    by_salt = full.select(*mark, salt, "id").groupBy(*mark, "salt").agg(F.min("id").alias("id"))
    classes = scratch.save(by_salt.groupBy(*mark).agg(F.min("id").alias("rep")), "classes")
    reps = scratch.save(full.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", F.col("n_shingles").alias("n"), "keys", "odd"), "reps")
    facts = reps.select("id", "n", "odd")
    # a half key that no other class has can't make a cell, so only shared ones are combined
    halves = reps.select("id", F.posexplode("keys").alias("at", "half")).select(F.xxhash64("at", "half").alias("key"), "id", "at")
    shared = scratch.save(halves.groupBy("key").count().where("count > 1").select("key"), "shared")
    halves = scratch.save(halves.join(shared, "key", "left_semi").select("id", "at", "key"), "halves")
    u, v = halves.where(F.col("at") < SIDE).select("id", F.col("key").alias("u")), halves.where(F.col("at") >= SIDE).select("id", F.col("key").alias("v"))
    met = scratch.save(u.join(v, "id").select(F.xxhash64("u", "v").alias("key"), "id"), "met")
    scratch.drop(halves)
    cells = scratch.save(_sized(met, scratch), "cells")
    scratch.drop(met)
    # All candidates come from these cells, so whole texts move once. Their ids grow with the input: a shuffled join, whatever their size.
    texts = scratch.save(texts.join(cells.select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    sweep(spark)

    large = cells.where(F.col("size") > SMALL_CELL)  # of the others all pairs are compared
    links = compared = roots = None
    while True:
        pairs = _pairs(cells)
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        if pairs.isEmpty():
            break
        new = confirm(texts, pairs, facts, scratch)
        compared = pairs if compared is None else compared.unionByName(pairs)
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        roots = components(links, scratch)
        # next: cells that still hold several components, one class of each
        root = F.coalesce("root", "id")
        fewer = scratch.save(cells.select("key", "id").join(roots, "id", "left").groupBy("key", root.alias("r")).agg(F.min("id").alias("id")).select("key", "id"), "fewer")
        cells = scratch.save(_sized(fewer, scratch), "cells")
        scratch.drop(fewer)

    if compared is not None and not large.isEmpty():
        pairs = scratch.save(_left_over(texts, large.select("key", "id"), roots, scratch).join(compared, ["a", "b"], "left_anti"), "pairs")
        new = confirm(texts, pairs, facts, scratch)
        if not new.isEmpty():
            roots = components(new if links is None else links.unionByName(new), scratch)

    by_class = classes.withColumnRenamed("rep", "id")
    by_class = by_class.join(roots, "id", "left") if roots is not None else by_class.withColumn("root", F.lit(None).cast("long"))
    by_class = by_class.select(*mark, F.coalesce("root", "id").alias("root"))
    answer = by_salt.select(*mark, "salt").join(by_class, mark)
    done = full.select("id", *mark, salt).join(answer, [*mark, "salt"], "left").select("id", "n_shingles", F.coalesce("root", "id").alias("root"))
    rest = rows.where("not (n_shingles > 0 and id is not null)").select("id", "n_shingles", F.col("id").alias("root"))
    out = done.unionByName(rest)
    kept: Column = F.col("id").eqNullSafe(F.col("root"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"), kept.alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays; rows with a null id stay."""
    return docs.join(cluster(docs).where("not kept").select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)
