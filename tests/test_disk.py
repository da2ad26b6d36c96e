"""What is left on disk: stored tables that nothing reads any more, and shuffles that tables in buckets do without."""

import os

import pytest
from pyspark.sql import functions as F

from targetry.operators import diff, merkle
from targetry.plans import fixtures
from targetry.sources import tables

SF = "/root/testdata/sf0.001"


def stored(spark) -> set[str]:
    return set(os.listdir(tables.shared_dir(spark).removeprefix("file://").removeprefix("file:")))


@pytest.mark.parametrize("cycle", [False, True])
def test_hashing_leaves_nothing(spark, cycle):
    deps = {"a": ["b", "c", ""], "b": ["c", "gone"], "c": ["d"], "d": ["a"] if cycle else [], "top": ["a", "a"]}
    t = spark.createDataFrame([(n, n.encode(), None, d) for n, d in deps.items()], "name string, own binary, fixed string, deps array<string>")
    before = stored(spark)
    hashes = merkle.hash_graph(t)
    assert len({r.hash for r in hashes.collect()}) == 5
    tables.forget(hashes)
    assert stored(spark) == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_revisions_are_joined_where_they_lie(spark):
    before = stored(spark)
    pair = [fixtures.hashed(fixtures.bucketed_graph(spark, SF, w)) for w in ("before", "after")]
    assert len(stored(spark) - before) == 4  # two graphs, two revisions
    for frame in (diff.all_targets(*pair), diff.narrow(*pair)):
        assert "Exchange" not in frame.select("name", "change_type")._jdf.queryExecution().executedPlan().toString()
    tables.forget(*pair)


def test_shuffle_files_go_with_the_table(spark):
    t = tables.store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert t.count() == 7 and spark.conf.get(tables.CLEANUP) == "false"


def test_a_task_writes_many_groups(spark, tmp_path):
    from targetry.sources import graphs

    t = spark.range(4000).select(F.concat(F.lit("//p"), F.col("id") % 997, F.lit(":t"), "id").alias("name"), F.md5(F.col("id").cast("string")).alias("hash"))
    one = graphs.put(t, f"file://{tmp_path}", "one", like=graphs.Graph(spark, "", graphs.Layout(64), t.schema))
    files = [f for d, _, names in os.walk(one.path.removeprefix("file://") + "/rows") for f in names if f.endswith(".parquet")]
    assert len(files) == 64 and len({f.split("-")[1] for f in files}) <= 8  # the tasks that wrote them
    assert one.rows().count() == 4000 and one.find(["//p5:t5"]).first().hash and one.rows().columns == ["name", "hash"]
