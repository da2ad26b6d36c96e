"""Periodic runs against a plain search of all periods."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from targetry.llm import runs
from targetry.llm.smaller import next_smaller, previous_smaller


def plain(words: list, least: int) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 7), st.integers(0, 59), st.sampled_from([2, 5, 12]))
def test_runs_of_any_words(words, p, a, least):
    made = [words[i] if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i in range(len(words))]
    for w in (words, made):
        ids = np.unique(np.array(w, np.int64), return_inverse=True)[1] if w else np.empty(0, np.int64)
        assert [tuple(map(int, r)) for r in zip(*runs.runs_of(ids, least), strict=True)] == plain(w, least)


@given(st.lists(st.integers(0, 5), max_size=80), st.booleans())
def test_smaller_values(values, strict):
    v = np.array(values, np.int64)
    fits = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
    assert previous_smaller(v, strict=strict).tolist() == [max((j for j in range(i) if fits(v[j], v[i])), default=-1) for i in range(len(v))]
    assert next_smaller(v, strict=strict).tolist() == [min((j for j in range(i + 1, len(v)) if fits(v[j], v[i])), default=len(v)) for i in range(len(v))]


def test_one_word_many_times():
    found = runs.runs_of(np.zeros(50_000, np.int64))
    assert [x.tolist() for x in found] == [[0], [50_000], [1]]


def test_texts(spark):
    random.seed(5)
    texts = [None, "", " \t\n", "a", "xé " * 30, "　" * 3, "one  two\tone two\n" * 6 + "three " + "b c d e " * 5, "a b " * 40_000, "a b " * 6, "a b " * 6]
    for _ in range(200):
        unit = [random.choice("abcd") + "ü" * random.randrange(2) for _ in range(random.randrange(1, 9))]
        texts.append(" ".join(random.choice("abcd") for _ in range(random.randrange(20))) + " " + " ".join(unit * random.randrange(1, 6)))
    rows = [(i, t, "own", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string, n int").repartition(3)
    found = {r["doc_id"]: r for r in runs.find(docs, carry=("doc_id", "runs"), prefix="f_").collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        words = (t or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        want = [(0, 80_000, 2)] if i == 7 else plain(words, 12)
        assert found[i]["runs"] == "own" and found[i]["f_n_words"] == len(words)
        assert [(r["start"], r["length"], r["period"]) for r in found[i]["f_runs"]] == want
        assert found[i]["f_collapsed"] == collapsed(words, want)


def test_empty_table(spark):
    assert runs.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("least", [2, 12])
def test_texts_don_t_touch(spark, least):
    docs = spark.createDataFrame([(i, "a b c") for i in range(9)], "doc_id int, text string").coalesce(1)
    assert all(r["runs"] == [] for r in runs.find(docs, least=least).collect())
