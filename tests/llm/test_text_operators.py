"""Language, pages, packing, quality, chat, toxicity and pieces: exact versions, round trips, held-out accuracy, edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat_format, language_id, packing, page_text, pieces, quality_rules, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, (t, g) in enumerate(zip(texts, langs, strict=True))], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# language


def test_language_of_held_out_documents(spark):
    rows = language_id.op1_language_id(spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 20])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == (n if n > 1 else 1)


def test_language_edges(spark):
    texts = [None, "", "123 !!", "word", "x" * 200_000]
    none = language_id.identify(frame(spark, texts), None).orderBy("doc_id").collect()
    assert [r.lang_pred for r in none] == ["und"] * 5
    one = language_id.train(frame(spark, ["hello there world"] * 40, ["en"] * 40))
    got = language_id.identify(frame(spark, texts), one).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 3 + [("en", 1.0)] * 2
    assert language_id.train(frame(spark, ["a"] * 5, [None] * 5)) is None
    assert language_id.identify(frame(spark, []), None).collect() == []


# pages


def page(spark, rows):
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    return [(r.text, r.n_chars) for r in got]


def test_article_without_its_frame(spark):
    html = (
        "<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>Menu</a></nav><div class='cookie-notice'>Cookies</div><article><h1>Head &amp; line</h1>"
        "<p>One\n  two<br>three <b>four</b></p><p>A &lt; b &eacute;</p><div class=\"ad\">Buy</div><section id='comments'><p>First!</p></section></article><aside>Side</aside><form>Mail <input></form><footer>&copy; x</footer><script>var t='</p>';</script>"
    )
    assert page(spark, [(1, "http://a.b/c", html)]) == [("Head & line\n\nOne two three four\n\nA < b é", 40)]


def test_lines_shared_with_the_nearest_pages_go_where_there_is_no_article(spark):
    rows = [(i, f"https://h.example/p/{i}", f"<p>Welcome to the site</p><p>Text number {i} says something of its own, quite long.</p><p>All rights reserved</p>") for i in range(30)]
    rows.append((99, "https://other.example/p", "<p>Welcome to the site</p><p>Alone</p>"))
    got = page(spark, rows)
    assert [t for t, _ in got[:30]] == [f"Text number {i} says something of its own, quite long." for i in range(30)]
    assert got[30][0] == "Welcome to the site\n\nAlone"


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(i, f"https://h.example/{i}", "<article><p>The same article on every page.</p><p>With a second line.</p></article>") for i in range(5)]
    assert {t for t, _ in page(spark, rows)} == {"The same article on every page.\n\nWith a second line."}


def test_frames_go_and_articles_keep_their_own_lines(spark):
    def html(i, bar=True):
        return f"<article><h1>Title {i}</h1><p>Text of page {i}, with some words.</p>" + "<p>A sentence that half of the pages have.</p>" * (i % 2) + "<p>Share this page</p>" * bar + "</article>"

    rows = [(i, f"https://h.example/{i:03}", html(i)) for i in range(40)]
    got = page(spark, rows)
    assert all("Share this page" not in t for t, _ in got[2:-2]) and all("Share this page" in t for t, _ in got[:2] + got[-2:])  # at the ends of a host fewer than four pages tell
    assert all(("half of the pages" in t) == bool(i % 2) for i, (t, _) in enumerate(got))
    frame_ = "<p>Start</p><p>News</p><p>Sport and weather and much more of it</p>{}<p>About the people who make these pages</p><p>Imprint</p>"
    short = [(i, f"https://s.example/{i}", frame_.format(f"<p>Note {i}</p>")) for i in range(20)]
    short += [(20 + k, "https://s.example/9", frame_.format("<p>Note 9</p>")) for k in range(5)]  # equal pages are one place
    assert [t for t, _ in page(spark, short)] == [f"Note {i}" for i in range(20)] + ["Note 9"] * 5


def test_pages_equal_a_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()
    rng = random.Random(3)
    rows = [tuple(r) for r in rows] + [(10_000 + i, f"http://f.example/{rng.randint(0, 40)}", "".join(f"<p>{rng.choice('abcdefghij') * rng.randint(1, 3)}</p>" for _ in range(rng.randint(0, 9)))) for i in range(120)]
    parsed = []
    for i, url, html in rows:
        m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*))?([^?#]*)", url or "")
        lines, main = page_text.candidates(html or "")
        parsed.append({"order": ((m[1] or "").lower(), m[2], i), "host": (m[1] or "").lower(), "main": main, "hashes": lines, "sizes": [len(x) for x in lines]})
    places = []
    for p in sorted(parsed, key=lambda p: p["order"]):
        if places and all(places[-1][0][c] == p[c] for c in ("host", "main", "hashes")):
            places[-1].append(p)
        else:
            places.append([p])
    want = {}
    for k, place in enumerate(places):
        near = [places[j][0] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < len(places) and places[j][0]["host"] == place[0]["host"]]
        gone = page_text.shared(place[0], near)
        want |= {p["order"][2]: "\n\n".join(x for i, x in enumerate(p["hashes"]) if i not in gone) for p in place}
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_page_edges(spark):
    assert page(spark, []) == []
    odd = [(1, None, None), (2, "::", ""), (3, "http://x", "<p>cut off <b>in a ta"), (4, "http://x", "<p>a</p><script>never closed"), (5, "http://y", "plain & text &am"), (6, "http://y/z", "<nav>only</nav>"), (7, "http://z", "<p>" + "w " * 200_000 + "</p>")]
    got = [t for t, _ in page(spark, odd)]
    assert got[:6] == ["", "", "cut off in a ta", "a", "plain & text &am", ""] and len(got[6]) == 399_999


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = page_text.common(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))


# packing


def test_packing_of_documents(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    extra = ["", "it's a.'s DON'T x.,'ll!!", "É. é.\nÑ,\n", "<|endoftext|> b", "a b " * 3000, "\x1c x\x85y", "日本. 語", "a_b. 5.5%"]
    texts = [r.text for r in documents(spark).limit(60).collect()] + extra
    rows = packing.pack(frame(spark, [*texts, None])).collect()
    by = {(r.doc_id, r.piece): r for r in rows}
    for i, t in enumerate([*texts, ""]):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            own = ids[a : a + 2048]
            r = by.pop((i, p))
            assert (r.start, r.length, r.ids_crc32) == (a, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes()))
    assert not by
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= 1 + -(-sum(r.length for r in rows) // 2048)


def test_plans_use_every_piece_once_and_little_room():
    rng = np.random.default_rng(7)
    for size, n in ((64, 300), (2048, 5000), (10, 1), (50, 0)):
        lengths = rng.integers(1, size + 1, n)
        counts = np.bincount(lengths, minlength=size + 1)
        patterns = packing.plan(counts)
        used = Counter()
        for own, times in patterns:
            assert sum(own) <= size
            for x in own:
                used[x] += times
        assert used == Counter({int(x): int(c) for x, c in enumerate(counts) if c})
        assert sum(t for _, t in patterns) <= -(-lengths.sum() // size) * 1.34 + 1


def test_exact_fillings_are_found_whenever_there_are_some():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = np.zeros(61, np.int64)
        np.add.at(counts, rng.integers(1, 61, rng.integers(1, 9)), 1)
        have = np.repeat(np.arange(61), counts).tolist()
        gaps = packing.Gaps(counts)
        for gap in range(1, 61):
            there = any(sum(c) == gap for n in (1, 2, 3) for c in combinations(have, n))
            found = gaps.exact((), gap)
            assert (found is not None) == there and (not there or sum(found) == gap and gaps.fits(found))


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, [])).collect() == []


# quality


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[(w[i], w[i + 1], w[i + 2])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_a_plain_version(spark):
    texts = [r.text for r in documents(spark).collect()] + [None, "", "a b c a b c", "x\x1cy z\x85w", "l\nl\n \nm\nl", "é ü " * 5000]
    got = quality_rules.measure(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == [plain_counts(t) for t in texts]


def test_learned_rules_find_planted_junk():
    rng = np.random.default_rng(3)
    n = 3000
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.2) & (x["c"] > 0.7))
    rules = quality_rules.learn(x, bad, rng.random(n) < 0.3)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= quality_rules._holds(r, x, n)
    assert (hit == bad).mean() > 0.97 and len(rules) <= 6
    assert quality_rules.learn(x, np.zeros(n, bool), rng.random(n) < 0.3) == []


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.train(quality_rules.measure(frame(spark, ["a b"])), empty) == []
    rows = quality_rules.measure(frame(spark, [None, "w " * 60])).withColumn("v", quality_rules.verdict([])).collect()
    assert [r.v for r in rows] == [None, None]
    assert quality_rules.op5_quality_rules(spark, SF).where("base_failed and kept").isEmpty()


# chat


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "a\\</s>", "[/INST]\\\\[INST]", "", None, "<s>é</s>", "x" * 50_000]
    roles = ["user", "assistant", "[INST]", None, "system", "</s>", "assistant", "user", "assistant"]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(zip(roles, odd, strict=True))], "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(0))
    done = chat_format.format_turns(chat_format.from_table(df))
    r = done.select(chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("segments")).alias("loss")).first()
    assert [(x.role, x.text) for x in r.t] == [(a or "", b or "") for a, b in zip(roles, odd, strict=True)]
    assert r.loss == "\\" + "" + "x" * 50_000


def test_layouts_by_fingerprint(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "n", "output": "o"}, {"instruction": "i", "input": "", "output": "o"}, {"messages": [{"role": "User", "content": "u"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"history": [["q", "r"]], "prompt": "p", "response": "s"}, {"system": "y", "prompt": "p", "response": "s"}, {"unknown": 1},
    ]
    texts = [json.dumps(r) for r in records] + ["not json", None]
    got = chat_format.from_json(spark.createDataFrame(list(enumerate(texts)), "id long, j string"), "id", "j").orderBy("conv_id").collect()
    u, a = "user", "assistant"
    want = [[(u, "p"), (a, "c")], [(u, "i\n\nn"), (a, "o")], [(u, "i"), (a, "o")], [(u, "u"), (a, "a")], [(u, "h"), (a, "g")], [(u, "q"), (a, "r"), (u, "p"), (a, "s")], [("system", "y"), (u, "p"), (a, "s")], [], [], []]
    assert [[(t.role, t.text) for t in r.turns] for r in got] == want
    assert got[1].layout == got[2].layout != got[0].layout
    more = [{"id": 5, "completion": "c", "prompt": "p", "text": 1}, {"meta": {"a": 1}, "messages": [{"id": 1, "content": "u", "role": "user"}]}, {"messages": []}]
    got = chat_format.from_json(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(more)], "id long, j string"), "id", "j").orderBy("conv_id").collect()
    assert [[(t.role, t.text) for t in r.turns] for r in got] == [[(u, "p"), (a, "c")], [(u, "u")], []]
    typed = spark.createDataFrame([(1, ([("user", "u", 3)],)), (2, None)], "id long, r struct<messages: array<struct<role: string, content: string, id: int>>>")
    got = chat_format.to_turns(typed, "r").orderBy("id").collect()
    assert [(t.role, t.text) for t in got[0].turns] == [("user", "u")] and got[1].turns == [] and got[0].layout == chat_format.to_turns(typed.selectExpr("id", "to_json(r) as r"), "r").where("id = 1").first().layout


def test_order_and_ties_of_turns(spark):
    rows = [(1, 2, "b", "x"), (1, None, "z", "n"), (1, 1, "b", "q"), (1, 1, "b", "p"), (1, 1, "a", "r"), (None, 0, "u", "m"), (1, 1, "b", "p")]
    got = chat_format.from_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: [t.text for t in r.turns] for r in got} == {1: ["n", "r", "p", "p", "q", "x"], None: ["m"]}
    clash = spark.createDataFrame([("p", "t", 1, 0, "user", 5, "x")], "prompt string, text string, conv_id long, turn long, role string, content int, record string")
    assert [[(t.role, t.text) for t in r.turns] for r in chat_format.from_table(clash).collect()] == [[("user", "t")]]
    assert chat_format.from_table(clash.where("false")).collect() == []
    with pytest.raises(ValueError):
        chat_format.from_table(spark.range(1))


# toxicity


def test_toxic_sentences_are_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    texts, labels = [], []
    for i in range(600):
        sentences = [" ".join(word() for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 20))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += f" {rng.choice(['zogwurst', 'zogling', 'quazfink'])}{rng.choice(['', 'en', 'er'])} {word()}"
        texts.append(". ".join(sentences) + ".")
        labels.append((i, 1, int(bad)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, [*texts, None, "", "zogwurst"])
    model = toxicity.train(docs, marks)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(rows[i].score >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    assert all("zog" in rows[i].sentence or "quaz" in rows[i].sentence for i in held if i % 4 == 0)
    assert rows[600].score == rows[601].score == 0.0 and rows[602].score > 0.5
    kept = toxicity.drop_toxic(docs, marks)
    odd = toxicity.score(frame(spark, ["İstanbul İİİ. You zogwurst now! İ end."]), model).first()
    assert odd.sentence == "You zogwurst now!"
    assert toxicity.score(docs.where("false"), model).collect() == [] and toxicity.drop_toxic(docs.where("false"), marks).collect() == []
    more = docs.withColumns({c: F.lit(1) for c in ("score", "worst", "sentence", "toxic", "label")})
    assert toxicity.drop_toxic(more, marks).columns == more.columns
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.score < 0.5}


def test_worst_sentence_of_a_text_whose_lower_case_is_longer():
    word = int(toxicity.features_of(["zogwurst"])[0][0, 0])
    model = toxicity.Model(np.asarray([word]), np.asarray([6.0]), -5.0)
    text = "İstanbul İİİ. You zogwurst now! İ end."
    scores, text_of, spans = toxicity.sentence_scores(model, [text])
    assert scores.argmax() == 1 and len(text.lower()) > len(text)


def test_toxicity_without_both_labels(spark):
    docs = frame(spark, ["some words", None])
    for rows, score in (([], 0.0), ([(0, 1, 0)], 0.0)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert [round(r.score, 6) for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == [score, 0.0]


# pieces


def test_long_words_equal_the_library_and_take_little_time():
    import time

    import sentencepiece
    from public_tokenizers import path

    rng = random.Random(4)
    library = sentencepiece.SentencePieceProcessor(model_file=path(pieces.MODEL))
    encoder = pieces.Encoder()
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [made("abcdeth ing" if i % 3 else "aé漢😀z0=", n) for i, n in enumerate((1, 199, 200, 201, 202, 500, 3000, 20_000))] + ["a" * 5000, "ab" * 3000, "the" * 400 + " " + "0" * 700]
    for t in texts:
        assert encoder.encode([t, "short " + t])[0].tolist() == library.encode(t)
    assert all(len(w) <= pieces.LONG_WORD for w in encoder)
    long = made("abcdefghijklmnopqrstuvwxyz0123456789+/", 1_000_000)
    began = time.time()
    found = encoder.encode([long])[0]
    assert time.time() - began < 60 and encoder.decode(found) == long and found.tolist() == library.encode(long)


def test_pieces_equal_the_library(spark):
    import sentencepiece
    from public_tokenizers import path

    library = sentencepiece.SentencePieceProcessor(model_file=path(pieces.MODEL))
    extra = ["", "  a  b   c    ", "\n\n x", "日本語 テスト 😀😀 ñandú", "    " * 9 + "x", "<s> hello </s> <0x41>", "a\tb\r\n c", " lead", "trail ", "\n", " ", "x" * 3000]
    texts = [r.text for r in documents(spark).limit(80).collect()] + extra
    encoded = pieces.encode(frame(spark, [*texts, None]))
    assert [list(r.ids) for r in encoded.orderBy("doc_id").collect()] == [*library.encode(texts), []]
    assert [r.text for r in pieces.decode(encoded).orderBy("doc_id").collect()] == [*texts, ""]
    assert pieces.encode(frame(spark, [])).collect() == []


def test_op8_round_trip(spark):
    assert pieces.op8_sentencepiece(spark, SF).where("not round_trip").isEmpty()


def test_digest_of_decoded_text(spark):
    r = pieces.op8_sentencepiece(spark, SF).orderBy("doc_id").first()
    d = documents(spark).orderBy("doc_id").first()
    assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
