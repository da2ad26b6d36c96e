"""Stored graphs: digests, groups, what a diff reads."""

import pytest
from pyspark.sql import functions as F

from targetry.operators import diff
from targetry.operators.phases import Phases
from targetry.sources import graphs, tables

SCHEMA = "name string, hash string, rule_type string, deps array<string>, attributes map<string,string>"


def rows(n, packages=40, change=()):
    return [(f"//p{k % packages}:t{k}", f"h{k}{'+' if k in change else ''}", "rule", [f"//p{(k - 1) % packages}:t{k - 1}"] if k % 3 else [], {}) for k in range(n)]


@pytest.fixture
def base(spark, tmp_path):
    return f"file://{tmp_path}"


def same(spark, before, after, **how):
    """The diff by digests and the one of whole tables."""
    cols = ["name", "change_type", "is_seed", "distance"]
    by = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    found = by(diff.diff(before, after, **how))
    assert found == by(diff.diff(before.rows(), after.rows(), **how))
    return found


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        inner = node.plan() if "QueryStage" in node.getClass().getSimpleName() else None
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
    return total


def test_few_changes_read_few_rows(spark, base, monkeypatch):
    monkeypatch.setattr(graphs, "ROWS_OF_GROUP", 20)
    a = spark.createDataFrame(rows(4000, 400), SCHEMA)
    b = spark.createDataFrame(rows(4000, 400, {7, 8, 1203, 1204}), SCHEMA)
    one = graphs.put(a, base, "one")
    two = graphs.put(b, base, "two", like=one)
    assert one.layout.groups == 256 and one.rows().count() == 4000
    left, right, share = graphs.pruned(one, two)
    assert share <= 4 / 256
    assert 0 < scanned(left.select("name", "hash")) < 0.05 * 4000 and scanned(right) < 0.05 * 4000
    found = same(spark, one, two)
    assert [f[0] for f in found] == sorted(f"//p{k % 400}:t{k}" for k in (7, 8, 1203, 1204))
    assert dict((f[0], f[3]) for f in found) == {"//p7:t7": 0, "//p8:t8": 1, "//p3:t1203": 0, "//p4:t1204": 1}


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_any_share_of_changes(spark, base, monkeypatch, share):
    monkeypatch.setattr(graphs, "ROWS_OF_GROUP", 30)
    change = {k for k in range(900) if (k * 7919) % 1000 < share * 1000}
    one = graphs.put(spark.createDataFrame(rows(900), SCHEMA), base, "one")
    two = graphs.put(spark.createDataFrame(rows(900, change=change)[50:] + rows(950)[900:], SCHEMA), base, "two", like=one)
    found = same(spark, one, two)
    assert sum(f[1] == diff.DELETED for f in found) == 50 and sum(f[1] == diff.NEW for f in found) == 50
    same(spark, one, two, max_distance=1)


def test_folded_and_foreign_layouts(spark, base, monkeypatch):
    monkeypatch.setattr(graphs, "ROWS_OF_GROUP", 10)
    one = graphs.put(spark.createDataFrame(rows(800), SCHEMA), base, "one")
    monkeypatch.setattr(graphs, "ROWS_OF_GROUP", 40)
    two = graphs.put(spark.createDataFrame(rows(800, change={5}), SCHEMA), base, "two")
    assert (one.layout.groups, two.layout.groups) == (64, 16)
    assert graphs.differing(one, two).count() == graphs.differing(two, one).count() == 1
    assert same(spark, one, two) == [("//p5:t5", "CHANGE_TYPE_CHANGED", True, 0)]
    # a package with most rows is spread; layouts that spread others can't be compared by digests
    hot = graphs.put(spark.createDataFrame(rows(800, packages=1), SCHEMA), base, "hot")
    assert dict(hot.layout.spread)["p0"] == 16
    assert hot.digests().agg(F.max("n")).first()[0] < 200
    assert graphs.differing(one, hot) is None and graphs.pruned(one, hot)[2] == 1.0


def test_put_again_and_missing(spark, base):
    assert graphs.get(spark, base, "none") is None
    graphs.put(spark.createDataFrame(rows(30), SCHEMA), base, "g")
    old = graphs.get(spark, base, "g")
    new = graphs.put(spark.createDataFrame(rows(31), SCHEMA), base, "g")
    assert old.rows().count() == 30 and graphs.get(spark, base, "g") == new and new.rows().count() == 31
    empty = graphs.put(spark.createDataFrame([], SCHEMA), base, "e")
    assert [f[1] for f in same(spark, empty, new)] == [diff.NEW] * 31 and same(spark, empty, empty) == []


def test_find(spark, base, monkeypatch):
    monkeypatch.setattr(graphs, "ROWS_OF_GROUP", 40)
    g = graphs.put(spark.createDataFrame(rows(600, 100), SCHEMA), base, "g")
    found = g.find(["//p5:t5", "//p7:t107", "//p7:none"])
    assert sorted(r.name for r in found.collect()) == ["//p5:t5", "//p7:t107"] and scanned(found) < 300
    assert g.find([]).count() == 0


def test_null_hash_counts_as_empty(spark, base):
    one = graphs.put(spark.createDataFrame([("//a:a", None, "rule", [], {}), ("//a:b", "", "rule", [], {})], SCHEMA), base, "one")
    two = graphs.put(spark.createDataFrame([("//a:a", "", "rule", [], {}), ("//a:b", None, "rule", [], {})], SCHEMA), base, "two", like=one)
    assert graphs.differing(one, two).count() == 0 and same(spark, one, two) == []


def test_phases(spark, base):
    one = graphs.put(spark.createDataFrame(rows(300), SCHEMA), base, "one")
    two = graphs.put(spark.createDataFrame(rows(300, change={4, 5}), SCHEMA), base, "two", like=one)
    phases = Phases(spark)
    diff.diff(one, two, phases=phases).collect()
    found = phases.report()
    assert list(found) == ["align", "rows", "reverse", "seed", "bfs"]
    assert found["rows"]["changed"] == 2 and found["reverse"]["links"] == 1 and found["seed"]["seeds"] == 1
    assert found["bfs"]["reached"] == 1 and found["bfs"]["levels"] == 1 and found["align"]["jobs"] >= 1


def test_many_links_are_bucketed(spark, monkeypatch):
    """A level's plan doesn't shuffle links that are stored in buckets."""
    monkeypatch.setattr(diff, "BUCKET_EDGES", 8)
    n = 60
    changed = spark.createDataFrame([(f"t{k:02}", k == 0) for k in range(n)], "name string, is_seed boolean")
    links = spark.createDataFrame([(f"t{k + 1:02}", f"t{k:02}") for k in range(5)] + [(f"t{k:02}", "t03") for k in range(10, n)], "src string, dst string")
    plain = {r.name: r.distance for r in diff.distances(changed, links, n_links=55).collect()}
    assert plain["t05"] == 5 and plain["t30"] == 4 and plain["t06"] == -1
    table = tables.bucketed(links, "dst", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        join = table.join(changed.select(F.col("name").alias("dst")), "dst")
        text = join._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange") == 1 and "Bucketed: true" in text
    tables.forget(table)
