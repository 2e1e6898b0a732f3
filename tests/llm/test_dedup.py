"""Exact, near and substring dedup against plain versions, and their edge cases."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import exact_dedup, near_dedup, substring_dedup
from tallyforge.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(60, 200)) for _ in range(n)]
    passage = sentence(rng, 90)
    for i in range(0, n, 5):
        texts.append(texts[i].replace(" ", "  "))  # equal but for blanks
        words = texts[i].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))  # near copy
        texts.append(sentence(rng, 30) + " " + passage + " " + sentence(rng, 30))  # shared passage
    texts += [None, "", " \t\n", "a", "a", "one two three", "Ünïcödé wörds " * 80, "x" * 3000, "ab " * 5000]
    return texts


# exact


def plain_exact(texts, ids):
    groups = {}
    for i, t in zip(ids, texts, strict=True):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_a_plain_version(spark, weak):
    texts = corpus()
    ids = list(range(100, 100 + len(texts)))
    more = {"key": lambda t: F.unhex(F.hex(F.crc32(t.cast("binary")) % 5))} if weak else {}  # weak: hashes collide all the time
    rows = exact_dedup.decide(frame(spark, texts, ids), **more).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == plain_exact(texts, ids)


def test_exact_dedup_edges(spark):
    assert exact_dedup.decide(frame(spark, [])).collect() == []
    rows = exact_dedup.decide(frame(spark, ["a b", "ab", "ab", None], [7, 7, None, None])).collect()
    assert sum(r.kept for r in rows) == 2 and {r.group_size for r in rows} == {3, 1}
    kept = exact_dedup.drop_copies(frame(spark, ["x", "x", "y"], [1, 1, 2])).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]
    assert exact_dedup.drop_copies(frame(spark, ["x"])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# near


def plain_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def plain_components(texts, ids):
    sets, root = plain_sets(texts), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(zip(ids, sets, strict=True), 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True)}


def near(spark, texts, ids):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.cluster(frame(spark, texts, ids)).collect()}


def test_near_dedup_equals_a_plain_version(spark):
    texts = corpus(2)
    ids = list(range(len(texts), 0, -1))
    assert near(spark, texts, ids) == plain_components(texts, ids)


def test_near_dedup_of_a_chain_and_a_large_group(spark):
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    chain = [list(base)]
    for k in range(12):  # each differs a little from the one before, the ends differ a lot
        words = list(chain[-1])
        words[8 * k + 3] = f"w{k}"
        chain.append(words)
    group = []
    for k in range(60):  # many near copies of one text
        words = list(base[::-1])
        words[k] = f"g{k}"
        group.append(words)
    texts = [" ".join(w) for w in chain + group]
    ids = rng.sample(range(10_000), len(texts))
    assert near(spark, texts, ids) == plain_components(texts, ids)


def test_near_dedup_of_a_template_family_compares_all_pairs(spark):
    rng = random.Random(8)
    template = sentence(rng, 300)  # two members share about 0.7; those with half of their own words in common are near copies
    own = [(sentence(rng, 30), sentence(rng, 30)) for _ in range(240)]
    for k in range(40):
        own[3 * k + 1] = (own[3 * k][0], own[3 * k + 1][1])
    texts = [f"{template} {a} {b}" for a, b in own] + [sentence(rng, 150) for _ in range(20)]
    ids = rng.sample(range(10_000), len(texts))
    want = plain_components(texts, ids)
    assert len({root for _, root, _ in want.values()}) == len(texts) - 40
    assert near(spark, texts, ids) == want


@pytest.mark.parametrize("block", [3, near_dedup.BLOCK])
def test_left_over_pairs_are_all_that_can_be_near(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(9)
    base = sentence(rng, 150).split()
    texts = []
    for _ in range(90):  # similarities from about 0.5 to 1, of different lengths
        words = base[rng.randint(0, 25) : len(base) - rng.randint(0, 25)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(500)}"
        texts.append(" ".join(words))
    texts += ["a b c", "c d e", "a b c d e f", "a b c d e f g", *(" ".join("abcdefgh"[: 4 + k]) for k in range(4))]
    ids = rng.sample(range(1000), len(texts))
    root = {i: i if k % 3 else ids[0] for k, i in enumerate(ids)}
    cells = spark.createDataFrame([(7, i) for i in ids], "key long, id long")
    roots = spark.createDataFrame([(i, r) for i, r in root.items() if i != r], "id long, root long")
    rows = near_dedup._left_over(frame(spark, texts, ids).selectExpr("doc_id as id", "text"), cells, roots, Scratch(spark, "t")).collect()
    got = {(r.a, r.b) for r in rows}
    sets = dict(zip(ids, plain_sets(texts), strict=True))
    near_pairs = {(min(i, j), max(i, j)) for i, j in combinations(ids, 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(rows) == len(got) and all(a < b and root[a] != root[b] for a, b in got)
    assert near_pairs and got >= {(a, b) for a, b in near_pairs if root[a] != root[b]}


def test_near_dedup_edges(spark):
    assert near_dedup.cluster(frame(spark, [])).collect() == []
    assert near(spark, [None, "", "a b", "A B"], [4, 3, 2, 1]) == {4: (0, 4, True), 3: (0, 3, True), 2: (1, 1, False), 1: (1, 1, True)}
    rows = near_dedup.cluster(frame(spark, ["a b c", "a b c", "a b c"], [5, 5, None])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (5, 5, True), (5, 5, True)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(50)] + [(200, 200 + k) for k in range(1, 90)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            m = min(root[a], root[b])
            root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}


# substrings


def plain_cut(texts, span=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + span] for b in raw for k in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = True
        runs = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def plain_passages(texts, span=240, words=51):
    """What is left of each text, and the bytes in passages: maximal runs of bytes covered by repeated strings, with so many whole words."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + span] for b in raw for k in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                gone[k : k + span] = [True] * span
        runs = [m.span() for m in re.finditer(b"1+", bytes(49 if g else 48 for g in gone))]
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        runs = [(x, y) for x, y in runs if sum(x <= u and v <= y for u, v in places) >= words]
        kept = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(b)], strict=True))
        out.append((kept.decode("utf-8", "ignore"), len(b) - len(kept)))
    return out


def cut(spark, texts, ids=None):
    rows = substring_dedup.cut(frame(spark, texts, ids)).orderBy("doc_id").collect()
    assert [r.n_passage for r in rows] == [n for _, n in plain_passages(texts)]
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows]


@pytest.mark.parametrize("many", [0, substring_dedup.MANY])
def test_repeats_equal_a_plain_version(spark, many, monkeypatch):
    monkeypatch.setattr(substring_dedup.repeats, "__defaults__", (substring_dedup.SPAN, substring_dedup.GRAM, many))
    rng = random.Random(4)
    base = sentence(rng, 500)
    # cuts of one text with edges everywhere, lengths around the threshold, repeats inside a text, runs of one letter
    texts = corpus(3, 20) + [base, base[100:499] + "q", base[100:500] + "q", "q" + base[700:1300] + "z" + base[50:600], base[:1000] + "!" + base[:1000]]
    texts += [base[a : a + rng.randint(390, 900)] for a in rng.sample(range(1500), 12)]
    assert cut(spark, texts) == plain_cut(texts)


def test_repeats_edges(spark):
    assert cut(spark, []) == []
    two = ["é" * 400, "é" * 400]
    assert cut(spark, two) == plain_cut(two)
    rows = substring_dedup.cut(frame(spark, ["k" + "ab" * 300] * 2 + [None], [9, 9, None])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 601, 601]
    words = "é" + " b" * 200
    kept = substring_dedup.without_passages(frame(spark, ["x" + words, words + " y", None, "z" * 300, "z" * 300])).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in kept] == [("x", 1), ("y", 1), (None, None), ("z" * 300, 300), ("z" * 300, 300)]


def test_passages_equal_a_plain_version(spark):
    texts = corpus(7, 20)
    rng = random.Random(12)
    passage = sentence(rng, 58)  # over 50 words, but no string of 400 bytes
    texts += [sentence(rng, 40) + " " + passage + " " + sentence(rng, 40) for _ in range(6)] + [sentence(rng, 50) + " " + passage[:250]]
    kept = substring_dedup.without_passages(frame(spark, texts)).orderBy("doc_id").collect()
    want = plain_passages(texts)
    assert [r.text or "" for r in kept] == [t for t, _ in want]
    assert all(n >= len(passage) for _, n in want[-7:-1]) and want[-1][1] == 0


CLASHES = "id long, mark int, at int, raw string, kept boolean, key string, n_bytes long, root long, first int, firsts string, size int, others string, p int, n long, a long, b long, u long, v long, salt int, norm string, score double, task int, length long"


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, near_dedup.drop_near_copies, substring_dedup.without_passages])
def test_stages_with_odd_rows_and_clashing_columns(spark, stage):
    rng = random.Random(13)
    long_text = sentence(rng, 180_000)  # about 1 MB
    texts = [None, "", "a b", "a b", long_text, long_text, sentence(rng, 100), None]
    ids = [1, 2, 3, 3, 4, 5, None, None]
    docs = frame(spark, texts, ids)
    more = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in CLASHES.split(", "))]
    rows = stage(docs.select("*", *more))
    assert rows.columns == [*docs.columns, *(c.split()[0] for c in CLASHES.split(", "))]
    plain_rows = stage(docs)
    assert sorted(map(str, rows.select(*docs.columns).collect())) == sorted(map(str, plain_rows.collect()))
    assert stage(docs.where("false")).collect() == []


def test_a_long_text_is_scanned_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    piece = sentence(rng, 150)
    texts = [sentence(rng, 3000) + piece + sentence(rng, 3000), "k " + piece]
    want = plain_cut(texts)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    whole = substring_dedup.samples(data, np.asarray([0, len(data)]))
    parts = [substring_dedup.samples(data[a : a + 5000 + 399], np.asarray([0, len(data[a : a + 5000 + 399])])) for a in range(0, len(data), 5000)]
    assert sum(int((p[2] - p[1] + 1).sum()) for p in parts) == int((whole[2] - whole[1] + 1).sum())
    assert cut(spark, texts) == want
