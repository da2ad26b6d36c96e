"""Graphs stored in groups of packages, with a digest of each group's names and hashes.

A folder has the rows, a folder and file for each group, sorted by name; the digests, a row for each group with its folder; and a
manifest, which is written last. A task writes the files of many groups. Two graphs of one layout compare their digests first and read files of groups that differ.

The group of a target comes from its package, so that an edit of a package touches one group or few; packages with many
times a group's rows are spread over several by name. The number of groups is a power of two: a graph with more groups than
another folds its digests, which are sums without carry, to the other's groups.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from targetry.functions.labels import package_of
from targetry.sources.tables import bucket_count, cleaning, read_text, write_text

#: Rows that a group has on average, at least half of it and at most twice; no graph has more groups than MOST_GROUPS.
ROWS_OF_GROUP = 640
MOST_GROUPS = 1 << 16
#: A package with so many times a group's rows is spread.
HOT = 4
#: Of groups that differ, the share from which all is read.
MOST_PRUNED = 0.5


@dataclass(frozen=True)
class Layout:
    """groups: their number; spread: for packages with many rows, how many parts each has."""

    groups: int
    spread: tuple[tuple[str, int], ...] = ()

    def group(self, name: Column) -> Column:
        package = package_of(name)
        part = F.lit(0).cast("long")
        if self.spread:
            parts = F.create_map(*[F.lit(x) for pair in self.spread for x in pair])
            part = F.coalesce(F.pmod(F.xxhash64(name), F.try_element_at(parts, package)), part)
        return F.pmod(F.xxhash64(package, part), F.lit(self.groups)).cast("int")


def plan(targets: DataFrame) -> Layout:
    """A layout for a graph of that size. At most groups / HOT packages are spread."""
    sizes = targets.groupBy(package_of(F.col("name")).alias("package")).agg(F.count("*").alias("n"))
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = min(MOST_GROUPS, 1 << max(0, round(math.log2(max(1, n / ROWS_OF_GROUP)))))
    own = n / groups
    hot = sizes.where(F.col("n") > HOT * own).collect() if groups > 1 else []
    return Layout(groups, tuple(sorted((r["package"], math.ceil(r["n"] / own)) for r in hot)))


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    path: str
    layout: Layout
    schema: T.StructType

    def rows(self, files: list[str] | None = None) -> DataFrame:
        """All rows, or those of some groups' folders. The folder is listed once; other groups are left out when the scan is
        planned. Graphs stored before there were folders have file names instead."""
        all_ = self.spark.read.schema(_grouped(self.schema)).parquet(f"{self.path}/rows")
        if files is not None:
            old = [f for f in files if not f.isdigit()]
            all_ = all_.where(F.col("_metadata.file_name").isin(old) if old else F.col("_group").isin([int(f) for f in files]))
        return all_.select(*self.schema.names)

    def find(self, names: list[str]) -> DataFrame:
        """Rows of some names. Only files of their groups are read; within a file rows lie in order of name."""
        asked = self.spark.createDataFrame([(n,) for n in names], "name string").select(self.layout.group(F.col("name")).alias("group")).distinct()
        files = [r["file"] for r in self.digests().join(F.broadcast(asked), "group").select("file").distinct().collect()]
        return self.rows(files).where(F.col("name").isin(names))

    def digests(self, groups: int | None = None) -> DataFrame:
        """group (folded to fewer groups if asked), file, n, one, two."""
        d = self.spark.read.schema("group int, file string, n long, one long, two long").parquet(f"{self.path}/digests")
        return d.withColumn("group", F.col("group") % (groups or self.layout.groups))


def _grouped(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_group", T.IntegerType())])


def put(targets: DataFrame, base: str, key: str, like: Graph | None = None) -> Graph:
    """Stores a graph (name, hash, ...) under a key, in the layout of another one if given. What was there stays readable
    until the new manifest takes its place."""
    spark = targets.sparkSession
    layout = like.layout if like is not None else plan(targets)
    folder = f"{base}/{key}"
    path = f"{folder}/{uuid.uuid4().hex}"
    tasks = min(layout.groups, max(bucket_count(targets), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = targets.withColumn("_group", layout.group(F.col("name"))).repartition(tasks, "_group").sortWithinPartitions("_group", "name")
    with cleaning(spark):
        rows.write.option("compression", "zstd").partitionBy("_group").parquet(f"{path}/rows")
    hash_ = F.coalesce("hash", F.lit(""))
    written = spark.read.schema(_grouped(targets.schema)).parquet(f"{path}/rows").select("name", hash_.alias("hash"), F.col("_group").alias("group"))
    digests = written.groupBy("group", F.col("group").cast("string").alias("file")).agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("name", "hash")).alias("one"), F.bit_xor(F.xxhash64("hash", "name")).alias("two")
    )
    with cleaning(spark):
        digests.coalesce(1).write.parquet(f"{path}/digests")
    meta = {"path": path, "groups": layout.groups, "spread": layout.spread, "schema": targets.schema.jsonValue()}
    write_text(spark, f"{folder}/manifest.json", json.dumps(meta))
    return Graph(spark, path, layout, targets.schema)


def get(spark: SparkSession, base: str, key: str) -> Graph | None:
    """The graph under the key, None if there is none."""
    text = read_text(spark, f"{base}/{key}/manifest.json")
    if text is None:
        return None
    meta = json.loads(text)
    return Graph(spark, meta["path"], Layout(meta["groups"], tuple((p, k) for p, k in meta["spread"])), T.StructType.fromJson(meta["schema"]))


def differing(before: Graph, after: Graph) -> DataFrame | None:
    """group, before_files, after_files of groups whose digests differ; None if the layouts can't be compared. Equal digests
    of both sides cancel out, so that one aggregation compares them."""
    if before.layout.spread != after.layout.spread:
        return None
    groups = min(before.layout.groups, after.layout.groups)
    side = lambda g, sign: g.digests(groups).withColumn("n", F.col("n") * sign).withColumn("old", F.lit(sign > 0))
    files = lambda old: F.collect_set(F.when(F.col("old") == old, F.col("file")))
    both = side(before, 1).union(side(after, -1)).groupBy("group").agg(
        F.sum("n").alias("n"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"), files(True).alias("before_files"), files(False).alias("after_files")
    )
    return both.where("n <> 0 OR one <> 0 OR two <> 0").select("group", "before_files", "after_files")


def pruned(before: Graph, after: Graph) -> tuple[DataFrame, DataFrame, float]:
    """Rows of both graphs, without groups whose digests agree: of those, names and hashes are the same; and the share of
    groups that differ. File names of differing groups, a few for each of MOST_GROUPS at most, pass through the driver."""
    found = differing(before, after)
    if found is None:
        return before.rows(), after.rows(), 1.0
    rows = found.collect()
    share = len(rows) / min(before.layout.groups, after.layout.groups)
    if share > MOST_PRUNED:
        return before.rows(), after.rows(), share
    files = lambda c: sorted({f for r in rows for f in r[c]})
    return before.rows(files("before_files")), after.rows(files("after_files")), share
