"""Clean paths, links and whole folders against the operating system's own functions and a walk by hand."""

import hashlib
import os
import posixpath
import random

import pytest
from pyspark.sql import functions as F

from targetry.operators import incremental
from targetry.sources import folders, parsers


def test_clean_and_relative(spark):
    r = random.Random(9)
    some = ["", ".", "/", "//", "a//b/./c/..", "../../a", "/../a", "a/../../b", "/a/b/../../..", "./", "a/..", "..", "/a/./b//"]
    some += ["/".join(r.choice(["a", "b", "..", ".", "", "c"]) for _ in range(r.randrange(1, 8))) for _ in range(200)]
    rows = spark.createDataFrame([(s,) for s in some], "p string").select("p", folders.clean(F.col("p")).alias("c")).collect()
    norm = lambda p: posixpath.normpath("/" + p.lstrip("/")) if p.startswith("/") else posixpath.normpath(p or ".")
    assert {x.p: x.c for x in rows} == {p: norm(p) for p in some}
    full = ["/" + "/".join(r.choice("abc") for _ in range(r.randrange(5))) for _ in range(60)]
    pairs = [(a, b) for a in full[:30] for b in full[30:]]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", folders.relative(F.col("a"), F.col("b")).alias("w")).collect()
    assert all(x.w == posixpath.relpath(x.b, x.a) for x in rows)


def by_hand(root):
    """The walk in lexical order, entry by entry."""
    h = hashlib.sha1()
    framed = lambda b: len(b).to_bytes(8, "big") + b

    def walk(folder):
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if os.path.islink(path):
                target = os.readlink(path)
                target = os.path.relpath(target, folder) if target.startswith("/") else posixpath.normpath(target)
                h.update(b"\x02" + framed(name.encode()) + framed(target.encode()))
            elif os.path.isdir(path):
                h.update(b"\x00" + framed(name.encode()))
                walk(path)
            else:
                data = open(path, "rb").read()
                h.update(b"\x01" + framed(name.encode()) + hashlib.sha1(b"blob %d\0" % len(data) + data).digest())

    walk(root)
    return h.hexdigest()


def test_whole_folders(spark, tmp_path):
    top = tmp_path / "work" / "mod"
    (top / "sub" / "deep").mkdir(parents=True)
    (top / "sub-x").mkdir()
    (top / "empty").mkdir()
    (tmp_path / "work" / "else").mkdir()
    for name, data in {"a.go": b"package a", "sub/b": b"b", "sub/deep/c": bytes(range(256)), "sub.txt": b"s", "sub-x/d": "ünï".encode(), "../else/t": b"t"}.items():
        (top / name).write_bytes(data)
    for link, target in {"l1": str(top / "sub" / "b"), "sub/l2": "../a.go", "sub/deep/l3": ".././/deep/../b", "l4": str(tmp_path / "work" / "else"), "sub-x/l5": str(top)}.items():
        os.symlink(target, top / link)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([str(top / "sub"), str(top / "sub-x" / "d"), str(top / "a.go"), str(top / "sub.txt"), str(tmp_path / "work" / "else")])
    found = [(os.path.join(d, n), os.readlink(os.path.join(d, n))) for d, ds, ns in os.walk(top) for n in [*ds, *ns] if os.path.islink(os.path.join(d, n))]
    links = spark.createDataFrame(found, "path string, target string")
    empty = spark.createDataFrame([(str(top / "empty"),)], "path string")
    roots = spark.createDataFrame([(str(top),), (f"file:{top}/sub",), (f"{top}/nothing",)], "directory string")
    got = {r.directory: r.hash for r in parsers.directory_hashes(folders.entries(roots, files, links, empty)).collect()}
    assert got == {str(top): by_hand(top), str(top / "sub"): by_hand(top / "sub")}
    # walked by the executors, also what the binaryFile source leaves out
    (top / "sub" / "none").write_bytes(b"")
    (top / ".hidden").mkdir()
    (top / ".hidden" / "_x").write_bytes(b"y" * 3_000_000)
    got = {r.directory: r.hash for r in parsers.directory_hashes(folders.walked(roots.where("directory NOT LIKE '%nothing'"))).collect()}
    assert got == {str(top): by_hand(top), str(top / "sub"): by_hand(top / "sub")}
    os.mkfifo(top / "pipe")
    with pytest.raises(Exception, match="unsupported directory entry pipe"):
        parsers.directory_hashes(folders.walked(roots.limit(1))).collect()
    with pytest.raises(Exception, match="nothing"):
        folders.walked(roots).collect()


def test_content_behind_links_is_left_out(spark):
    files = spark.createDataFrame([("file:/m/l/x", bytearray(b"1")), ("file:/m/k", bytearray(b"2")), ("file:/m/l2", bytearray(b"3"))], "path string, content binary")
    links = spark.createDataFrame([("/m/l", "/else"), ("/m/l2", "k")], "path string, target string")
    rows = folders.entries(spark.createDataFrame([("/m",)], "directory string"), files, links).collect()
    assert sorted((r.path, r.kind, r.link) for r in rows) == [("k", "file", None), ("l", "symlink", "../else"), ("l2", "symlink", "k")]


def test_united_scans(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int")
    two = spark.createDataFrame([("b", "n"), ("c", "m")], "name string, y string")
    assert sorted(incremental.united(one, two).collect(), key=str) == [("a", 1, None), ("b", 2, None), ("c", None, "m")]


@pytest.mark.parametrize("hit", ["rule", "other"])
def test_rule_of_another_repository_changes(spark, hit):
    sha = lambda *b: hashlib.sha1(b"".join(b)).digest()
    def graph(rule, other):  # noqa: E306
        r, o, a = sha(rule), sha(other), sha(b"app", sha(rule))
        own = [("//external:r", r, rule, [], None, "external rule"), ("//o:o", o, other, [], None, "rule"), ("@r//x:y", r, None, [], ["//external:r"], "unknown rule"), ("//app:a", a, b"app", ["@r//x:y"], None, "rule")]
        return {n: h.hex() for n, h, *_ in own}, [(n, h.hex(), bytearray(w) if w else None, d, k, t) for n, h, w, d, k, t in own]

    kind = "name string, hash string, own binary, deps array<string>, walk array<string>, rule_type string"
    _, before = graph(b"1", b"1")
    want, after = graph(b"2" if hit == "rule" else b"1", b"2" if hit == "other" else b"1")
    name = "//external:r" if hit == "rule" else "//o:o"
    fresh = [(n, None, *rest) for n, _, *rest in after if n == name]
    packages = spark.createDataFrame([("external" if hit == "rule" else "o",)], "package string")
    out = incremental.update(spark.createDataFrame(before, kind), spark.createDataFrame(fresh, kind), packages, packages.limit(0))
    assert {r.name: r.hash for r in out.collect()} == want
