"""Chunks, responses in ids, stored results."""

import random

from pyspark.sql import functions as F

from targetry.functions import sizes
from targetry.operators import chunks, diff, responses
from targetry.sources import stored

SCHEMA = "name string, hash string, rule_type string, deps array<string>, tags array<string>, root boolean, external boolean, attributes map<string,string>"


def greedy(values, most):
    out, total = [], 0
    for v in values:
        if not out or total + v > most:
            out.append([])
            total = 0
        out[-1].append(v)
        total += v
    return out


def test_chunks_against_plain_version(spark):
    for seed in range(4):
        r = random.Random(seed)
        values = [r.choice([1, 5, 9, 40, 70]) for _ in range(r.choice([1, 7, 60, 200]))]
        rows = spark.createDataFrame(list(enumerate(values)), "i long, n long")
        got = {}
        for x in chunks.numbered(rows, "n", 64, "i").collect():
            got.setdefault(x.chunk_no, []).append((x.i, x.n))
        assert [[n for _, n in sorted(got[k])] for k in sorted(got)] == greedy(values, 64) and sorted(got) == list(range(len(got)))
    assert chunks.numbered(spark.createDataFrame([], "i long, n long"), "n", 64, "i").count() == 0


def graph(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_changes_in_ids_and_back(spark):
    before = graph(spark, [("a", "1", "lib", ["b", "b", "c"], ["t"], True, False, {"x": "1"}), ("gone", "1", "bin", [], [], False, False, {})])
    after = graph(spark, [("a", "2", "lib", ["c"], ["u", "t"], True, False, {"x": "2", "y": "1"})])
    changed = diff.diff(before, after)
    rows, dicts = responses.changed_to_ids(changed)
    names = {k: {r.id: r.name for r in d.collect()} for k, d in dicts.items()}
    assert sorted(names["targets"].items()) == [(1, "a"), (2, "b"), (3, "c"), (4, "gone")]
    plain = lambda t: t and (names["targets"][t.id], t.hash, names["rule_types"][t.rule_type], [names["targets"][d] for d in t.deps], [names["tags"][x] for x in t.tags], {names["attribute_names"][k]: names["attribute_values"][v] for k, v in t.attributes.items()})
    got = {(plain(r.before) or plain(r.after))[0]: (r.change_type, plain(r.before), plain(r.after)) for r in rows.collect()}
    assert got["a"] == ("CHANGE_TYPE_CHANGED", ("a", "1", "lib", ["b", "b", "c"], ["t"], {"x": "1"}), ("a", "2", "lib", ["c"], ["u", "t"], {"x": "2", "y": "1"}))
    assert got["gone"][2] is None
    only, dicts = responses.changed_to_ids(changed, allowed=["y"])
    assert {r.name for r in dicts["attribute_names"].collect()} == {"y"}
    bare = rows.select(responses.stripped(F.col("after")).alias("t")).where("t IS NOT NULL").first().t
    assert bare.hash == "" and bare.tags == [] and bare.attributes == {} and len(bare.deps) == 1
    assert set(responses.needed_dictionaries(dicts)) == {"targets", "rule_types"}


def test_metadata_in_messages(spark):
    table = lambda words: spark.createDataFrame(list(enumerate(words, 1)), "id int, name string")
    dicts = {"targets": table(["x" * 10] * 5), "rule_types": table(["r"]), "tags": table([]), "attribute_names": table(["n"]), "attribute_values": table(["v" * 100, "w"])}
    got = {}
    for r in responses.metadata_chunks(dicts, 40).collect():
        got.setdefault(r.message, []).append((r.dictionary, r.id))
    assert {k: sorted(v) for k, v in got.items()} == {0: [("attribute_names", 1), ("rule_types", 1), ("targets", 1), ("targets", 2)], 1: [("targets", 3), ("targets", 4)], 2: [("targets", 5)], 3: [("attribute_values", 1)], 4: [("attribute_values", 2)]}


def test_sizes(spark):
    r = spark.range(1).select(sizes.map_entry_size(F.lit(0), F.lit(0)), sizes.map_entry_size(F.lit(300), F.lit(200)), sizes.changed_size(F.lit(3), F.lit(5), F.lit(None).cast("long"), F.lit(-1))).first()
    assert tuple(r) == (6, 1 + 2 + (1 + 2 + 1 + 2 + 200), 2 + 7 + 11)


def test_stored_results(spark, tmp_path):
    base = str(tmp_path)
    made = []

    def compute():
        made.append(1)
        return spark.createDataFrame([("b", 1), ("a", 2)], "name string, n int")

    assert stored.get(spark, base, "r/graphs/x") is None
    assert stored.cached(spark, base, "r/graphs/x", compute).count() == 2 and stored.cached(spark, base, "r/graphs/x", compute).count() == 2
    assert len(made) == 1
    for f in (tmp_path / "r/graphs/x").glob("part-*"):
        f.write_bytes(b"broken file")
        for crc in (tmp_path / "r/graphs/x").glob(".*.crc"):
            crc.unlink()
    assert stored.get(spark, base, "r/graphs/x") is None
    assert stored.cached(spark, base, "r/graphs/x", compute).count() == 2 and len(made) == 2
    assert stored.pointer(spark, base, "r/treehashes/1") == ""
    stored.put_pointer(spark, base, "r/treehashes/1", "abc")
    assert stored.pointer(spark, base, "r/treehashes/1") == "abc"
