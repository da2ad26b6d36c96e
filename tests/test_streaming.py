"""A graph kept up to date by a stream."""

from pyspark.sql import functions as F

from targetry.operators import merkle
from targetry.sources import stored
from targetry.streaming import revisions

SCHEMA = "name string, own binary, deps array<string>, rule_type string, package string"


def test_batches_become_versions(spark, tmp_path):
    base, files = str(tmp_path / "store"), str(tmp_path / "in")
    rows = [("//a:x", b"x", ["//b:y"], "rule", None), ("//b:y", b"y", [], "rule", None), ("//c:z", b"z", [], "rule", None)]
    first = spark.createDataFrame(rows, SCHEMA).drop("package")
    hashes = merkle.hash_graph(first.withColumn("fixed", F.lit(None).cast("string")))
    stored.put(first.join(hashes, "name").select("name", "hash", "own", "deps", "rule_type"), base, "graphs/none")
    updates = [("//b:y", b"y2", [], "rule", None), (None, None, None, None, "c")]
    spark.createDataFrame(updates, SCHEMA).coalesce(1).write.parquet(files)
    stream = spark.readStream.schema(SCHEMA).parquet(files)
    revisions.maintain(stream, base).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert stored.pointer(spark, base, "head") == "graphs/0"
    got = {r.name: r.change_type.removeprefix("CHANGE_TYPE_") for r in stored.get(spark, base, "diffs/0").collect()}
    assert got == {"//a:x": "CHANGED", "//b:y": "CHANGED", "//c:z": "DELETED"}
    now = stored.get(spark, base, "graphs/0")
    whole = merkle.hash_graph(now.select("name", "own", F.lit(None).cast("string").alias("fixed"), "deps", "rule_type"))
    assert {tuple(r) for r in now.select("name", "hash").collect()} == {tuple(r) for r in whole.collect()}
