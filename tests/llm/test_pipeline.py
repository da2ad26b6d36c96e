"""The pipeline on a small corpus: what each stage has to catch and to leave alone."""

import random

import pytest

import corpus_pipeline
from targetry.llm import jaccard, pii
from targetry.llm.common import table

WORDS = ["ra" + a + b for a in "abcdefgh" for b in "mnopqrst"]
COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    item = prose(30, 999)
    docs = []
    for i in range(240):
        t = prose(80, i)
        if i % 4 == 1:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if i % 4 == 3:
            t = t.replace(" ", " vileword ", 3)
        docs.append((i, t))
    docs += [(300 + i, prose(80, 4 * i) + " end") for i in range(10)]  # near copies of clean documents
    docs += [(400, prose(90, 4000) + " " + item), (401, item), (402, prose(80, 4001) + " write to joe@mail.example.com now"), (403, None), (404, "")]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 4 != 1), int(i % 4 == 3)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(docs), item


def test_stages(spark, corpus):
    d, texts, item = corpus
    docs, left = table(spark, d, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        path = f"{d}/stage{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert set(docs.columns) == COLUMNS
        left.append({r.doc_id: r for r in docs.collect()})
    clean = [i for i in range(240) if i % 4 in (0, 2)]
    assert sum(i in left[0] for i in clean) >= len(clean) - 1
    assert not any(i in left[0] for i in range(240) if i % 4 == 3)
    pairs = [(4 * i, 300 + i) for i in range(10)]
    assert all(not (a in left[1] and b in left[1]) and (a in left[1] or a not in left[0]) for a, b in pairs)
    assert 401 not in left[2] and item not in (left[2][400].text if 400 in left[2] else "")
    assert all(left[2][i].text == texts[i] for i in clean if i in left[2])
    if 402 in left[3]:
        assert "joe" not in left[3][402].text and "<EMAIL>" in left[3][402].text and left[3][402].n_chars == len(left[3][402].text)
    assert all(not pii.base_spans(r.text or "") for r in left[3].values())
    rows = docs.collect()
    assert {r.doc_id for r in rows} <= set(left[3])
    by = {}
    for r in rows:
        assert len(r.text.split()) == r.mix_words
        by.setdefault(r.source, [r.mix_target, 0])[1] += r.mix_words
    assert all(abs(target - words) <= 1 for target, words in by.values())


def test_brute_force_groups_agree(spark, corpus):
    d, *_ = corpus
    docs = table(spark, d, "documents")
    kept = {r.doc_id for r in jaccard.deduplicate(docs).collect()}
    named = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert kept == {i for i, c in named.items() if i == c}
