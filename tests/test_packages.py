"""Containing packages, touched packages, files that call for all targets, the snapshot store."""

import random

import pytest

from targetry.operators import diff, packages
from targetry.operators.changes import Patterns
from targetry.sources import snapshots

SCHEMA = "name string, hash string, rule_type string, deps array<string>, attributes map<string,string>"


def plain(path, known):
    parts = path.split("/")[:-1]
    return next((p for k in range(len(parts), -1, -1) if (p := "/".join(parts[:k])) in known), None)


@pytest.mark.parametrize("top", [True, False])
def test_nearest_folder(spark, top):
    r = random.Random(4)
    known = {"/".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(12)} | ({""} if top else set())
    paths = ["/".join([*(r.choice("abcd") for _ in range(r.randrange(5))), "f.go"]) for _ in range(200)] + ["f", "a", "aa/b.go"]
    rows = spark.createDataFrame([(p, "old", k) for k, p in enumerate(paths)], "path string, package string, k int")
    found = packages.containing(rows, spark.createDataFrame([(p,) for p in [*known, *known, None]], "package string"), strict=False)
    assert {r.k: r.package for r in found.collect()} == {k: plain(p, known) for k, p in enumerate(paths)}


def test_no_package(spark):
    paths = spark.createDataFrame([("a/x",), (None,)], "path string")
    none = spark.createDataFrame([], "package string")
    assert [r.package for r in packages.containing(paths, none, strict=False).collect()] == [None, None]
    with pytest.raises(Exception, match="no package contains a/x"):
        packages.containing(paths.where("path = 'a/x'"), none).collect()
    assert packages.containing(paths.limit(0), none).collect() == []


def test_touched(spark):
    known = spark.createDataFrame([("",), ("a",), ("a/b",), ("c",), ("d",)], "package string")
    changes = [("M", "a/b/x.go"), ("D", "c/BUILD"), ("D", "c/y.go"), ("A", "a/e/BUILD.bazel"), ("M", "d/deep/z.go"), ("M", "top.txt")]
    changed, gone = packages.touched(spark.createDataFrame(changes, "status string, path string"), known, Patterns())
    # c's files belong to the top now; a loses files to a/e
    assert sorted(r.package for r in changed.collect()) == ["", "a", "a/b", "a/e", "d"]
    assert [r.package for r in gone.collect()] == ["c"]
    empty = spark.createDataFrame([], "status string, path string")
    assert [df.count() for df in packages.touched(empty, known)] == [0, 0]


@pytest.mark.parametrize(
    ("b", "a", "differ"),
    [(None, None, False), (None, [], False), ([], None, False), (None, [("p", "1")], True), ([("p", "1")], None, True), ([("p", "1"), ("q", "2")], [("q", "2"), ("p", "1")], False),
     ([("p", "1")], [("p", "2")], True), ([("p", "1")], [("p", "1"), ("q", None)], True), ([("p", None)], [("p", None)], False), ([("p", "1"), ("p", "1")], [("p", "1")], False)],
)
def test_files_for_all_targets(spark, b, a, differ):
    table = lambda rows: None if rows is None else spark.createDataFrame(rows, "path string, hash string")
    assert diff.files_differ(table(b), table(a)) is differ
    one, two = (spark.createDataFrame([("//a:a", h, "rule", [], {}), ("//a:b", "1", "rule", [], {})], SCHEMA) for h in "12")
    found = {r.name: (r.change_type, r.distance) for r in diff.diff_or_all(one, two, table(b), table(a)).collect()}
    assert set(found) == ({"//a:a", "//a:b"} if differ else {"//a:a"}) and found["//a:a"] == ("CHANGE_TYPE_CHANGED", 0)


def test_snapshot_store(spark, tmp_path):
    s = snapshots.Store(spark, f"file://{tmp_path}")
    graph = lambda h: spark.createDataFrame([("//a:a", h, "rule", [], {})], SCHEMA)
    day = snapshots.DAY
    assert s.floor("r", 10) is None and s.latest("r", 10) is None
    for ts, sha in ((5 * day + 7, "aa"), (5 * day + 7, "bb"), (5 * day + 9, "0c"), (2 * day, "dd"), (0, "ee")):
        s.put("r", ts, sha, graph(sha))
    s.put("other", 5 * day + 8, "ff", graph("ff"))
    assert s.floor("r", 5 * day + 8) == (5 * day + 7, "bb") and s.floor("r", 99 * day) == (5 * day + 9, "0c")
    assert s.floor("r", 5 * day + 6) == (2 * day, "dd") and s.floor("r", day) == (0, "ee") and s.floor("r", 2 * day - 1) == (0, "ee")
    assert s.latest("r", 5 * day + 8).rows().first().hash == "bb" and s.get("r", 1, "aa") is None
    # days that aren't needed aren't listed: the remote's folder, and one day
    s.listed.clear()
    s.floor("r", 99 * day)
    assert len(s.listed) == 2
    s.put("r", 0, "ee", graph("new"))
    assert s.get("r", 0, "ee").rows().first().hash == "new"
    with pytest.raises(ValueError, match="no snapshot"):
        s.put("r", 1, "../x", graph("x"))
