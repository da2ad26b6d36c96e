"""Requests answered from stored results, cancelled requests, responses sent in order."""

import resource
import threading
import time

import pytest
from pyspark.sql import functions as F

from targetry.engine import Cancelled, Engine
from targetry.functions.requests import BuildDescription
from targetry.operators import stream
from targetry.sources import stored

SCHEMA = "name string, hash string, rule_type string, deps array<string>, attributes map<string,string>"


def chain(mark):
    return [("//p:f", f"f{mark}", "source file", [], {}), ("//p:l", f"l{mark}", "lib", ["//p:f"], {}), ("//q:b", f"b{mark}", "bin", ["//p:l"], {}), ("//q:same", "s", "bin", [], {})]


@pytest.fixture
def engine(spark, tmp_path):
    made = []

    def build(d, excluded):
        made.append(d.base_sha)
        return spark.createDataFrame(chain(d.base_sha[0]), SCHEMA)

    e = Engine(spark, f"file://{tmp_path}", build, lambda d: f"tree{d.base_sha[0]}")
    e.made, e.folder = made, tmp_path
    return e


def test_answers_from_storage(engine):
    one, two, other = (BuildDescription("r", s) for s in ("1a", "2a", "1b"))
    found = {r.name: r.distance for r in engine.changed(one, two).collect()}
    assert found == {"//p:f": 0, "//p:l": 0, "//q:b": 1} and engine.made == ["1a", "2a"]
    assert engine.changed(one, two, max_distance=0).count() == 2
    # another description of a known tree: neither a build nor a diff
    assert engine.changed(other, two).count() == 3 and engine.made == ["1a", "2a"]
    # other exclusions are other results
    engine.graph(one, excluded=("x",))
    assert engine.made == ["1a", "2a", "1a"]
    with pytest.raises(ValueError, match="same remote"):
        engine.changed(one, BuildDescription("elsewhere", "2a"))


def test_broken_page_is_a_miss(engine):
    one, two = BuildDescription("r", "1a"), BuildDescription("r", "2a")
    engine.changed(one, two)
    (key,) = [p for p in engine.folder.rglob("*compared-targets*/*") if p.is_dir()]
    for f in key.glob("part-*.parquet"):
        raw = bytearray(f.read_bytes())
        pages = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")  # the footer stays
        raw[4:pages] = b"\xff" * (pages - 4)
        f.write_bytes(bytes(raw))
    for crc in key.glob(".*.crc"):
        crc.unlink()
    base, name = engine.base, str(key.relative_to(engine.folder))
    assert stored.get(engine.spark, base, name) is not None and stored.whole(engine.spark, base, name) is None
    assert engine.changed(one, two).count() == 3 and engine.made == ["1a", "2a"]


def test_cancel(engine):
    began = threading.Event()

    def build(d, excluded):
        began.set()

        def wait(batches):
            time.sleep(120)
            yield from batches

        rows = engine.spark.createDataFrame(chain("9"), SCHEMA)
        rows.mapInPandas(wait, rows.schema).collect()
        return rows

    engine.build, out = build, []
    slow = BuildDescription("r", "9z")

    def ask():
        try:
            with engine.request("one"):
                out.append(engine.graph(slow))
        except Cancelled as e:
            out.append(e)

    thread = threading.Thread(target=ask)
    thread.start()
    assert began.wait(30)
    time.sleep(2)
    stopped = time.time()
    engine.cancel("one")
    thread.join(60)
    assert not thread.is_alive() and time.time() - stopped < 30
    assert isinstance(out[0], Cancelled)
    with pytest.raises(Cancelled), engine.request("one"):
        pass
    # the tree was written down before the build; the graph wasn't stored; another request builds it
    assert engine.tree_of(slow) == "tree9"
    engine.build = lambda d, excluded: engine.spark.createDataFrame(chain("9"), SCHEMA)
    with engine.request("two"):
        assert engine.graph(slow).rows().count() == 4


def test_chunks_in_order(spark, monkeypatch):
    monkeypatch.setattr(stream, "HELD_BYTES", 400)
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 37 + 1).alias("bytes")).repartition(7)
    words = spark.createDataFrame([(m, d, i, "w" * 9) for m in range(3) for d in "ab" for i in range(4)], "message long, dictionary string, id int, name string")
    sent = list(stream.send(rows, "bytes", 60, "id", metadata=words))
    assert [c.number for c in sent] == list(range(len(sent)))
    first = [c for c in sent if c.kind == stream.TARGETS]
    assert sent[: len(first)] == first and [r.id for c in first for r in c.rows] == list(range(500))
    assert all(sum(r.bytes for r in c.rows) <= 60 for c in first)
    assert [(r.message, r.dictionary, r.id) for c in sent[len(first) :] for r in c.rows] == [(m, d, i) for m in range(3) for d in "ab" for i in range(4)]


def test_empty_and_broken(spark, tmp_path):
    none = spark.range(0).select("id", F.lit(1).alias("bytes"))
    assert list(stream.send(none, "bytes", 10, "id")) == [stream.Chunk(0, stream.TARGETS)]
    path = tmp_path / "d"
    spark.range(1000).select("id", F.lit(1).alias("bytes")).repartition(4).write.parquet(str(path))
    table = spark.read.parquet(str(path))
    broken = sorted(path.glob("part-*"))[2]
    broken.write_bytes(b"PAR1" + b"\0" * 50 + b"PAR1")
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):  # noqa: B017  before anything is sent
        stream.send(table, "bytes", 10, "id")


def test_driver_memory_stays_flat(spark):
    rows = spark.range(400_000).select("id", F.lit(100).alias("bytes"), F.repeat(F.lit("x"), 80).alias("text"))
    before, n = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for c in stream.send(rows, "bytes", 100_000, "id"):
        n += len(c.rows)
    assert n == 400_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB; all rows as objects would take more
