"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.sources.tables import forget, keeping, store


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has a link: (node, component).

    edges: (a, b), any two comparable values of one type, no nulls. Alternates the large-star and small-star steps:
    each node hands its neighbours to the smallest of them, until every node hangs on its component's smallest.
    Edges stay distributed; each round is written to the shared folder, so rounds don't pile up lineage and the joins
    read plain scans, whose skewed partitions Spark can split.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    if now.isEmpty():
        return keeping(now.select(F.col("a").alias("node"), F.col("b").alias("component")), now)
    for _ in range(most_rounds):
        # large star: each node's larger neighbours are tied to its smallest neighbour (or to itself)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = store(
            now.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).where("a <> b").distinct()
        )
        # small star: each node and its smaller neighbours are tied to the smallest of them
        low = store(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = store(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        forget(*([last] if last is not None else []), least, large, low)
        last, now = now, new
        # done once every node hangs on one alone, which hangs on nothing: each star's centre is its smallest node
        if not now.groupBy("a").count().where("count > 1").isEmpty():
            continue
        if now.select(F.col("b").alias("c")).join(now.select("a"), F.col("c") == F.col("a"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components don't settle")
    forget(last)
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return keeping(nodes.union(now.select(F.col("b"), F.col("b")).distinct()), now)
