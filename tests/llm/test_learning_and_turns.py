"""Quality classifier, fill-in-middle and conversation repair: plain versions that share no code with the modules, SQL, held-out accuracy, odd rows."""

import hashlib
import heapq
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tallyforge.llm import fill_middle, quality_model, queries, turn_repair

SF = "/root/testdata/sf0.001"


def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_conversation_repair"])
def test_rows_of_the_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), duck(), queries.ORACLE_SQL[name])


# quality classifier


def test_quality_of_held_out_documents(spark):
    rows = quality_model.op11_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert len(rows) > 300 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in held if r.quality == 1]) >= 0.98  # clean documents stay
    better = [(a.score > b.score) + (a.score == b.score) / 2 for a in held if a.quality == 1 for b in held if b.quality == 0]
    assert np.mean(better) > 0.95


def n_grams(text):
    """All features of a text, written out."""
    found = {("c", text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1)}
    found |= {("c", (text + "\n")[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 2)}
    words = re.findall(r"[^ \t-\r]+", text)
    found |= {("w", tuple(words[i : i + n])) for n in (1, 2) for i in range(len(words) - n + 1)}
    kind = lambda c: "a" if c.islower() or c >= "ª" else "A" if c.isupper() else "0" if c.isdigit() else c
    shapes = [(re.sub(r"(.)\1+", r"\1", "".join(map(kind, w))), i > 0 and words[i - 1] == w) for i, w in enumerate(words)]
    return found | {("s", tuple(shapes[i : i + n])) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}


def test_indicators_are_the_n_grams():
    rng = random.Random(5)
    alphabet = ["Aa", "bB", "b", "12", "x#", "--", "é", "Été", "a", " ", " ", "\n", "!"]
    texts = ["", "one", "a a a b", "AB ab 12 #!"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    owner, _ = quality_model.indicators(texts)
    sizes = np.bincount(owner, minlength=len(texts))
    want = [len(n_grams(t)) if t else 0 for t in texts]
    assert all(0 <= w - s <= 1 for w, s in zip(want, sizes, strict=True)), [(t, w, s) for t, w, s in zip(texts, want, sizes, strict=True) if w != s]
    assert sum(w - s for w, s in zip(want, sizes, strict=True)) <= 3  # two n-grams may share a bucket
    alone = [set(quality_model.indicators([t])[1]) for t in texts]
    owner, bucket = quality_model.indicators(texts)
    assert alone == [set(bucket[owner == i]) for i in range(len(texts))]


def test_pieces_of_a_long_text(monkeypatch):
    text = " ".join(random.Random(1).choice(["alpha", "Beta", "g#", "42"]) for _ in range(300))
    whole = set(quality_model.indicators([text])[1])
    monkeypatch.setattr(quality_model, "PIECE", 40)
    cut = quality_model.indicators(["first", text, "last"])
    assert set(cut[1][cut[0] == 1]) <= whole and len(cut[1][cut[0] == 1]) > 0.9 * len(whole)
    assert "".join(x for _, g in quality_model._pieces(["ab " * 50, "x" * 100]) for x in g) == "ab " * 50 + "x" * 100


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    values = rng.normal(size=30)
    rows = [np.sort(rng.choice(30, rng.integers(1, 12), replace=False)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    cost = np.full(80, 0.7)
    w, bias = quality_model.dual_descent(rows, values, y, cost, passes=5000, tolerance=1e-9)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = values[r] / np.sqrt(len(r))
    x[:, 30] = 1.0

    def primal(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    v = np.append(w, bias)
    for scale in (1e-1, 1e-2, 1e-3):  # convex: no step anywhere near is better
        assert all(primal(v + scale * d) > primal(v) - 1e-3 for d in rng.normal(size=(300, 31)))
    best = np.zeros(31)
    for step in range(1, 20_000):  # plain subgradient steps come close and not below
        best -= (best - ((cost * y * (y * (x @ best) < 1)) @ x)) / (step + 50)
    assert primal(v) <= primal(best) + 1e-3


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([None, "", "word " * 10, "x" * 700_000, "word " * 10])] + [(None, "a null id", "en")], "doc_id long, text string, quality string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r.score for r in quality_model.score(docs, quality_model.train(docs, none)).collect()] == [0.5] * 6
    one = spark.createDataFrame([(i, 1) for i in range(5)] + [(2, 1)], "doc_id long, quality int")
    assert [r.score for r in quality_model.score(docs, quality_model.train(docs, one)).collect()] == [1.0] * 6
    many = spark.createDataFrame([(i, f"good words number {i} here" if i % 2 else f"### {i} $$$ bad%%") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (999, 0)], "doc_id long, quality int")
    model = quality_model.train(many, labels)
    got = {r.doc_id: r.score for r in quality_model.score(many, model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(200))
    rows = quality_model.score(docs, model).orderBy("doc_id").collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[0] == by_id[1] and by_id[2] == by_id[4]
    assert quality_model.score(docs.limit(0), model).collect() == []
    small = quality_model.train(many, labels, sample=20, entries=400)  # bounds hold, and the model still works
    assert np.mean([(p > 0.5) == bool(i % 2) for i, p in enumerate(quality_model.probabilities(small, [r.text for r in many.orderBy("doc_id").collect()]))]) > 0.9


# fill-in-middle


def plain_cut(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not n or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("chunk", "fan"), [(4, 2), (8, 3), (64, 256), (32_768, 256)])
def test_cuts_equal_a_plain_version(spark, chunk, fan):
    rng = random.Random(chunk)
    alphabet = ["a", "b", "\n", " ", "é", "ß", "€", "漢", "😀", "<", "<P", "P", "S>", ">", "<x>", "<", "<<M"]
    texts = ["", None, "<P>", "x<S>y", "<", "<P", "<P<P>", "aé", "😀", "<S" + "x" * 80, "é" * 200] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(250)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "no id " * 9, "n"), (None, "no id " * 9, "n"), (None, "another text " * 5, "n"), (7, "the id of another row " * 3, "n")]
    got = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string, marks string"), chunk=chunk, fan=fan)
    assert got.columns == ["doc_id", "text", "marks", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.withColumn("back", fill_middle.restore(got.output, got.form)).collect()
    assert all(r.back == (r.text or "") for r in found)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == sorted(((i, t, *plain_cut(i, t)) for i, t, _ in rows), key=key)


def test_cuts_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.transform(empty).collect() == []
    with pytest.raises(ValueError, match="form"):
        fill_middle.transform(empty.selectExpr("*", "1 AS form"))


def test_functions_of_chunks_compose():
    rng = random.Random(2)
    data = "".join(rng.choice("ab<PSM>é漢😀") for _ in range(500)).encode()
    whole = fill_middle.Scan(fill_middle.classes(data)).summary()
    for at in (0, 1, 2, 3, 7, 100, 333, len(data)):
        first, second = (fill_middle.Scan(fill_middle.classes(x)).summary() for x in (data[:at], data[at:]))
        assert whole[0] == [second[0][e] for e in first[0]]
        assert all(whole[i] == [first[i][s] + second[i][first[0][s]] for s in range(6)] for i in (1, 2))


# conversation repair


def plain_repair(rows):
    """Cost, audit and lines by trying every edit at every place; rows: (role, must go, truncated, text)."""
    n = len(rows)
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    done = {(0, ""): (0, "", ())}  # rows read and state of the grammar -> the least way there
    open_ = [(0, "", 0, "", ())]

    while open_:
        cost, audit, i, state, lines = heapq.heappop(open_)
        if done.get((i, state), (cost, audit))[:2] < (cost, audit):
            continue
        if i == n and state in ("", "a"):
            return cost, audit, lines
        steps = [(2, "I", i, x, (*lines, ({"u": "user", "a": "assistant"}[x], ""))) for x in after[state] if x != "s"]
        if i < n:
            role, gone, cut, text = rows[i]
            steps.append((3, "D", i + 1, state, lines))
            if not gone:
                steps += [(int(cut), "K", i + 1, x, (*lines, (role, text))) for x in after[state] if role[:1] == x]
                steps += [(2 + int(cut), "R", i + 1, x, (*lines, ({"u": "user", "a": "assistant"}[x], text))) for x in after[state] if x != "s"]
        for c, e, j, x, more in steps:
            new = (cost + c, audit + e)
            if new < done.get((j, x), (1 << 30, ""))[:2]:
                done[(j, x)] = (*new, more)
                heapq.heappush(open_, (*new, j, x, more))
    raise AssertionError("no way to the end")


@pytest.mark.parametrize("block", [1, 2, 3, 5, 16])
def test_audits_equal_a_plain_version(block):
    rng = random.Random(block)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "user", "assistant", ""]), rng.random() < 0.15, rng.random() < 0.2, "") for _ in range(rng.randint(0, 11))]
        codes = "".join(turn_repair.code(r[:1], gone, cut) for r, gone, cut, _ in rows)
        assert turn_repair.repair_codes(codes, block) == plain_repair(rows)[:2]


def test_long_conversations_take_linear_time():
    codes = "".join(random.Random(4).choice("suaUA-x") for _ in range(20_000))
    cost, audit = turn_repair.repair_codes(codes)
    price = {"D": 3, "I": 2, "K": 0, "R": 2}
    kept = [c for c, e in zip(codes, [e for e in audit if e != "I"], strict=True) if e != "D"]
    assert sum(price[e] for e in audit) + sum(c.isupper() or c == "+" for c in kept) == cost


def test_repair_of_odd_rows(spark):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", "tool", None, "User", ""], ["Fine.", "no end", "", None, " \t\n", "Who?  ", "a.b", "Fine."]
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts), 7) for _ in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit int")
    audited = turn_repair.audits(turn_repair.damage(df)).collect()
    by_id = {}
    for conv_id, turn, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            by_id.setdefault(conv_id, []).extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    assert {r.conv_id for r in audited} == set(by_id)
    for r in audited:
        own = sorted(by_id[r.conv_id], key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            fault = "blank" if not re.search(r"[^ \t-\r]", text) else "duplicate" if (role, text) in seen else "truncated" if not re.search(r"[.!?][ \t-\r]*\Z", text) else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, fault in ("blank", "duplicate"), fault == "truncated", text))
        cost, audit, _ = plain_repair(marked)
        turns = [t for t, _, _ in own if t is not None]
        assert (r.cost, r.audit, r.blank, r.duplicate, r.truncated) == (cost, audit, *counts.values())
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))


def test_repaired_turns(spark, tmp_path):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "x"), (3, 5, "system", "Be kind."), (4, 1, "user", "  "), (None, 0, "user", "Q."), (None, 1, "assistant", "A.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turn_repair.audits(df).write.parquet(f"{tmp_path}/audits")
    audited = spark.read.parquet(f"{tmp_path}/audits")
    assert {r.conv_id: r.audit for r in audited.collect()} == {1: "KIKK", 2: "D", 3: "D", 4: "D", None: "KK"}
    got = turn_repair.repair(df, audited).collect()
    texts = {}
    for r in got:
        texts.setdefault(r.conv_id, []).append((r.position, r.role, r.text, r.edit))
    assert texts == {1: [(0, "user", "Hi.", "K"), (1, "assistant", "", "I"), (2, "user", "Hello?", "K"), (3, "assistant", "Yes.", "K")], None: [(0, "user", "Q.", "K"), (1, "assistant", "A.", "K")]}
    assert turn_repair.audits(df.limit(0)).collect() == []
