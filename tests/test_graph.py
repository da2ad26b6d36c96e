import hashlib

import pytest
from pyspark.sql import functions as F

from targetry.functions import keys, labels
from targetry.operators import changes, diff, merkle, snapshots

SCHEMA = "name string, hash string, rule_type string, deps array<string>, attributes map<string,string>"


def graph(spark, rows):
    return spark.createDataFrame([(n, h, t, d, a) for n, h, t, d, a in rows], SCHEMA)


def outcome(df):
    return {r.name: (r.change_type.removeprefix("CHANGE_TYPE_"), r.distance) for r in df.collect()}


def chain(mark):
    return [
        ("//pkg:file.go", f"f{mark}", "source file", [], {}),
        ("//pkg:lib", f"l{mark}", "go_library", ["//pkg:file.go"], {}),
        ("//app:bin", f"b{mark}", "go_binary", ["//pkg:lib"], {}),
        ("//app:outer", f"o{mark}", "go_binary", ["//app:bin"], {}),
    ]


def test_source_change_propagates_and_limit(spark):
    b, a = graph(spark, chain(1)), graph(spark, chain(2))
    assert outcome(diff.diff(b, a)) == {"//pkg:file.go": ("CHANGED", 0), "//pkg:lib": ("CHANGED", 0), "//app:bin": ("CHANGED", 1), "//app:outer": ("CHANGED", 2)}
    assert outcome(diff.diff(b, a, max_distance=1))["//app:outer"] == ("CHANGED", -1)
    assert diff.within(diff.diff(b, a), 1).count() == 3


def test_membership(spark):
    b = graph(spark, [("gone", "1", "rule", [], {}), ("kept", "1", "rule", [], {}), ("same", "1", None, [], None)])
    a = graph(spark, [("kept", "2", "rule", [], {}), ("new", "1", "rule", [], {}), ("same", "1", None, [], {})])
    d = diff.diff(b, a)
    assert outcome(d) == {"gone": ("DELETED", 0), "kept": ("CHANGED", 0), "new": ("NEW", 0)}
    rows = {r.name: r for r in d.collect()}
    assert rows["gone"].after is None and rows["new"].before is None and rows["kept"].before.hash == "1"
    everything = outcome(diff.all_targets(b, a))
    assert everything["same"] == ("CHANGED", 0) and everything["gone"] == ("DELETED", 0)


def test_traversal_enters_changed_targets_only(spark):
    """S changed its attributes; C1 -> S, C2 -> C1, U -> S unchanged, X -> {C2, U}."""
    def rows(m, attr):
        return [("S", f"s{m}", "rule", [], {"a": attr}), ("C1", f"c1{m}", "rule", ["S"], {}), ("C2", f"c2{m}", "rule", ["C1"], {}), ("U", "u", "rule", ["S"], {}), ("X", f"x{m}", "rule", ["C2", "U"], {})]
    got = outcome(diff.diff(graph(spark, rows(1, "p")), graph(spark, rows(2, "q"))))
    assert {k: v[1] for k, v in got.items()} == {"S": 0, "C1": 1, "C2": 2, "X": 3}


def test_repeated_dependencies_and_cycles(spark):
    before = graph(spark, [("T", "1", "rule", ["a", "a"], {}), ("a", "1", "rule", [], {}), ("b", "1", "rule", [], {}), ("p", "1", "rule", ["q"], {}), ("q", "1", "rule", ["p"], {})])
    after = graph(spark, [("T", "2", "rule", ["a", "b"], {}), ("a", "2", "rule", [], {}), ("b", "1", "rule", [], {}), ("p", "2", "rule", ["q"], {}), ("q", "2", "rule", ["p"], {})])
    c = {r.name: r for r in diff.classify(before, after).collect()}
    assert not c["T"].dep_set_changed and not c["T"].is_seed
    got = outcome(diff.diff(before, after))
    assert got["p"] == ("CHANGED", -1) and got["q"] == ("CHANGED", -1) and got["T"] == ("CHANGED", 1)


def test_allowlist_and_empty_graphs(spark):
    b = graph(spark, [("s", "1", "source file", [], {}), ("t", "1", "rule", ["u"], {"k": "1"}), ("u", "1", "rule", [], {})])
    a = graph(spark, [("s", "1", "source file", [], {}), ("t", "2", "rule", ["u"], {"k": "2"}), ("u", "2", "rule", [], {})])
    seeds = lambda allowed: {r.name: r.is_seed for r in diff.classify(b, a, allowed).collect()}
    assert seeds(None) == {"t": True, "u": True}
    assert seeds(["other"]) == {"t": False, "u": True}
    none = graph(spark, [])
    assert diff.diff(none, none).count() == 0
    assert diff.diff(none, b).count() == 3


def nodes(spark, rows):
    return spark.createDataFrame([(n, n.encode(), f, d, "rule") for n, f, d in rows], "name string, own binary, fixed string, deps array<string>, rule_type string")


def sha(*parts):
    return hashlib.sha1(b"".join(parts)).hexdigest()


def test_merkle_levels_and_fixed(spark):
    t = nodes(spark, [("a", None, ["b", "b", "c"]), ("b", None, ["c"]), ("c", None, []), ("x", "", ["a"]), ("y", None, ["x"])])
    got = {r.name: r.hash for r in merkle.hash_graph(t).collect()}
    c = sha(b"c")
    b = sha(b"b", bytes.fromhex(c))
    assert got == {"c": c, "b": b, "a": sha(b"a", *[bytes.fromhex(x) for x in (b, b, c)]), "x": "", "y": sha(b"y")}


def test_merkle_cycle_is_entered_from_the_roots(spark):
    t = nodes(spark, [("r", None, ["q"]), ("p", None, ["q"]), ("q", None, ["p"])])
    got = {r.name: r.hash for r in merkle.hash_graph(t).collect()}
    p = sha(b"p")  # q is being hashed: an empty hash
    q = sha(b"q", bytes.fromhex(p))
    assert got["q"] == q and got["p"] == p
    assert got["r"] == sha(b"r", bytes.fromhex(q))


def test_reach_and_roots(spark):
    t = nodes(spark, [("r", None, ["q"]), ("q", None, ["s"]), ("s", None, []), ("z", None, [])])
    assert {r.name for r in merkle.roots(t).collect()} == {"r", "z"}
    start = spark.createDataFrame([("s",)], "name string")
    assert {r.name for r in merkle.dependents_of(t, start).collect()} == {"s", "q", "r"}


def test_labels(spark):
    one = spark.createDataFrame([("//a/b:c:d", "@@repo//x:y", "a/b/c", "top")], "l string, e string, p string, t string")
    l, e, p, t = (F.col(c) for c in "lept")
    r = one.select(labels.package_part(l), labels.name_part(l), labels.package_of(l), labels.canonical_repo(e), labels.external_rule(e), labels.path_label(p), labels.path_label(t), labels.package_part(t), labels.containing_packages(p)).first()
    assert list(r) == ["//a/b:c", "d", "a/b", "repo", "//external:repo", "//a/b:c", "//:top", "", ["a/b", "a", ""]]


def test_keys_and_snapshots(spark):
    assert keys.parse_snapshot_key(keys.snapshot_key("git@host:a/b", 86_400, "abc")) == ("git@host:a/b", 86_400, "abc")
    with pytest.raises(ValueError):
        keys.parse_snapshot_key("itg/x")
    s = spark.createDataFrame([("r", 5, "a"), ("r", 5, "b"), ("r", 9, "c"), ("o", 1, "z")], "remote string, commit_ts long, sha string")
    assert tuple(snapshots.floor(s, "r", 8).first()) == (5, "b")
    assert snapshots.floor(s, "r", 4).count() == 0
    probes = spark.createDataFrame([("r", 5, 1), ("r", 4, 2), ("r", 100, 3)], "remote string, ts long, id int")
    for bucket in (1, 3, 1 << 20):
        assert {r.id: r.sha for r in snapshots.floor_join(probes, s, "remote", bucket).collect()} == {1: "b", 2: None, 3: "c"}


def test_change_verdicts(spark):
    p = changes.Patterns(critical=("^WORKSPACE$",), ignored=(r"\.md$",))
    def verdict(*rows):
        return changes.verdict(spark.createDataFrame(list(rows), "status string, path string"), p).first().verdict
    assert verdict(("M", "a.md")) == changes.NO_CHANGE
    assert verdict(("M", "a.go"), ("M", "WORKSPACE")) == changes.FULL
    assert verdict(("M", "a.go")) == changes.REGULAR_ONLY
    assert verdict(("A", "a.go"), ("M", "x/BUILD")) == changes.REPARSE
    assert verdict(("M", "x.bzl")) == changes.UNKNOWN
    assert changes.verdict(spark.createDataFrame([], "status string, path string"), p).first().verdict == changes.NO_CHANGE
    with pytest.raises(ValueError):
        changes.check_pattern("(?=a)")
