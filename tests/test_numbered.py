"""Graphs in dense ids: numbering, levels by counts, reachability over edges in buckets."""

import random

import pytest

from targetry.operators import numbered


def make(spark, deps):
    rows = [(n, d, f"r{n}") for n, d in deps.items()]
    return numbered.graph(spark.createDataFrame(rows, "name string, deps array<string>, kind string"))


@pytest.fixture
def acyclic():
    r = random.Random(2)
    names = [f"t{k:03}" for k in range(90)]
    r.shuffle(names)
    return {n: r.sample(names[:k], min(k, r.randrange(4))) + ["missing"] * (k % 2) + [""] * (k % 3 == 0) for k, n in enumerate(names)}


def test_ids_and_edges(spark, acyclic):
    g = make(spark, acyclic)
    ids = {r.name: r.id for r in g.nodes.collect()}
    assert [n for n, _ in sorted(ids.items(), key=lambda x: x[1])] == sorted(acyclic) and sorted(ids.values()) == list(range(90))
    want = sorted((ids[n], ids[d], k) for n, deps in acyclic.items() for k, d in enumerate(deps) if d in ids)
    assert sorted((r.src, r.dst, r.ord) for r in g.inverse.collect()) == want == sorted((r.src, r.dst, r.ord) for r in g.forward.collect())
    assert g.nodes.where("kind = 'rt005'").first().name == "t005"
    g.drop()


def test_levels(spark, acyclic):
    acyclic |= {"x": ["y"], "y": ["x"], "z": ["x", "t001"]}  # a cycle, and what leads to it
    g = make(spark, acyclic)
    names = {r.id: r.name for r in g.nodes.collect()}

    def level(n):
        return max((level(d) + 1 for d in acyclic[n] if d in acyclic), default=0)

    found, rest, sizes = numbered.levels(g)
    got = {names[r.id]: r.level for r in found.collect()}
    assert got == {n: level(n) for n in acyclic if n not in "xyz"}
    assert sorted(names[r.id] for r in rest.collect()) == ["x", "y", "z"]
    assert sizes == [sum(v == k for v in got.values()) for k in range(len(sizes))]
    # a settled node doesn't wait
    settled = g.nodes.where("name = 'x'").select("id")
    got = {names[r.id]: r.level for r in numbered.levels(g, settled)[0].collect()}
    assert got["x"] == 0 and got["y"] == 1 and got["z"] == level("t001") + 1 if level("t001") else got["z"] == 1


@pytest.mark.parametrize("dependents", [True, False])
def test_reach(spark, acyclic, dependents):
    g = make(spark, acyclic)
    ids = {r.name: r.id for r in g.nodes.collect()}
    step = {n: {d for d in deps if d in ids} for n, deps in acyclic.items()}
    if dependents:
        step = {n: {m for m in step if n in step[m]} for n in step}
    start = ["t003", "t040"]
    want, front, k = dict.fromkeys(start, 0), set(start), 0
    while front:
        k += 1
        front = {m for n in front for m in step[n]} - set(want)
        want |= dict.fromkeys(front, k)
    found = g.reach(g.nodes.where(g.nodes.name.isin(start)).select("id"), dependents)
    assert {r.id: r.level for r in found.collect()} == {ids[n]: v for n, v in want.items()}


def test_empty_graph(spark):
    g = numbered.graph(spark.createDataFrame([], "name string, deps array<string>"))
    found, rest, sizes = numbered.levels(g)
    assert found.count() == rest.count() == g.inverse.count() == 0 and sizes == []
