"""Nearest neighbours against all distances."""

import math

import numpy as np
import pytest

from targetry.llm import nearest

KIND = "vec_id long, embedding array<float>, rank string"


def plain(rows, asked, k):
    fine = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = []
    for q, x in {(q, tuple(x)) for q, x in asked if q is not None and fine(x)}:
        found = []
        for i, y in rows:
            if i is not None and i != q and fine(y) and len(x) == len(y):
                total = 0.0
                for a, b in zip(x, y, strict=True):
                    total += (a - b) * (a - b)
                found.append((math.sqrt(total), i))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query", "rank", "vec_id", "distance").collect())


def table(spark, rows, kind="vec_id long, embedding array<double>, rank string"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], kind)


def test_all_distances(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(nearest, "STRIPE_BYTES", 12_000)
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 12)) * r.choice([1e-3, 1, 50], (400, 1))
    x[100:160] = x[7]  # ties
    x[200:230] = x[200] + r.standard_normal((30, 12)) * 1e-9
    rows = [(int(i * 3 % 400), v.tolist()) for i, v in enumerate(x)]
    asked = [(i, v) for i, v in rows if i % 7 == 0]
    found = nearest.search(table(spark, rows).repartition(5), table(spark, asked), k=5)
    assert got(found) == plain(rows, asked, 5)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0]), (9, [-1.0]), (None, [1.0, 2.0]),
            (10, [1e300, -1e300]), (11, [-1e300, 1e300]), (12, [1e-310, 0.0]), (13, [2.0, 1.0])]
    asked = [*rows, (0, [1.0, 2.0]), (13, [5.0, 5.0])]
    found = nearest.search(table(spark, rows), table(spark, asked), k=3)
    assert got(found) == plain(rows, asked, 3)
    assert nearest.search(table(spark, rows[:0]), table(spark, asked)).collect() == []
    assert nearest.search(table(spark, rows), table(spark, rows[:0])).collect() == []


def test_bound_holds():
    r = np.random.default_rng(8)
    x, y = r.standard_normal((50, 1500)), r.standard_normal((60, 1500)) * 100
    cx, sx, ex = nearest.quantise(x)
    cy, sy, ey = nearest.quantise(y)
    whole = nearest.products(cx, cy)
    assert (whole == cx.astype(int) @ cy.astype(int).T).all()
    coded = np.sqrt(((cx * sx[:, None])[:, None] - (cy * sy[:, None])[None]) ** 2 @ np.ones(1500))
    true = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert (np.abs(coded - true) <= ex[:, None] + ey + 1e-9).all()


@pytest.mark.parametrize("k", [1, 500])
def test_fewer_than_k(spark, k):
    rows = [(i, [float(i), 1.0]) for i in range(6)]
    assert got(nearest.search(table(spark, rows), table(spark, rows[:2]), k=k)) == plain(rows, rows[:2], k)
