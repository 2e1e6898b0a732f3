"""The pipeline against plain versions of its stages, on a small table."""

import random

import corpus_pipeline
import pytest

from tests.llm.test_dedup import plain_components, plain_exact, plain_passages, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [sentence(rng, rng.randint(60, 160)) for _ in range(60)]
    for i in range(0, 40, 4):
        texts.append(texts[i] + " ")
        words = texts[i + 1].split()
        words[20] = "other"
        texts.append(" ".join(words))
    passage = sentence(rng, 100)
    texts += [sentence(rng, 20) + passage + sentence(rng, 20) for _ in range(4)]
    bad = [" ".join(sentence(rng, 40).split()[:30] + ["you zogwurst and quazfink"]) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts + bad)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i >= len(texts))) for i in range(len(rows))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, bad


def test_stages_and_rows(spark, folder):
    path, texts, bad = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        seen.append((name, docs.columns, {r.doc_id: r for r in docs.collect()}))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert all(c == columns for _, c, _ in seen[:-1])
    clean = seen[0][2]
    assert {i for i in clean} == set(range(len(texts)))
    left = [t for t in texts]
    exact = [i for i, (keep, *_) in plain_exact(left, range(len(left))).items() if i == keep]
    assert set(seen[1][2]) == set(exact)
    near = [i for i, (_, root, _) in plain_components([left[i] for i in exact], exact).items() if i == root]
    assert set(seen[2][2]) == set(near)
    assert [seen[3][2][i].text for i in sorted(near)] == [t for t, _ in plain_passages([left[i] for i in sorted(near)])]
    assert set(seen[4][2]) == set(near)
    rows = corpus_pipeline.run(spark, path).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows} == {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect()}
