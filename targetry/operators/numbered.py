"""Graphs in dense ids, with edges stored in buckets of either end: levels of dependencies and reachability shuffle their
frontier, never the edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.sources.tables import bucketed, counted, counted_buckets, forget, keeping, range_count, store

#: Edges that a bucket has.
BUCKET_EDGES = 1 << 20
#: A level of at most so many nodes is sent to the edges, which then aren't even sorted.
BROADCAST_NODES = 100_000


@dataclass
class Numbered:
    """nodes: id (from 0, in order of name), name and further columns. inverse: src, dst, ord in buckets of dst. Edges to what
    isn't a node are left out."""

    nodes: DataFrame
    inverse: DataFrame
    buckets: int
    _forward: list[DataFrame] = field(default_factory=list)

    @property
    def forward(self) -> DataFrame:
        """The same edges in buckets of src, made when they are first asked for."""
        if not self._forward:
            self._forward.append(bucketed(self.inverse, "src", self.buckets))
        return self._forward[0]

    def reach(self, start: DataFrame, dependents: bool = True) -> DataFrame:
        """id, level of all that depends on start (id), or that start depends on; start itself at level 0."""
        if dependents:
            return spread(self.inverse.select(F.col("dst").alias("a"), F.col("src").alias("b")), start, self.buckets)
        return spread(self.forward.select(F.col("src").alias("a"), F.col("dst").alias("b")), start, self.buckets)

    def drop(self) -> None:
        forget(self.nodes, self.inverse, *self._forward)


def number(targets: DataFrame) -> tuple[DataFrame, dict]:
    """targets (name, deps, ...) with id, stored; n and the number of deps. Ranges of names are sorted and numbered each by
    itself, then shifted by the sizes of those before."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = targets.repartitionByRange(range_count(targets), "name").sortWithinPartitions("name")
    ranged, facts = counted(ranged.select("*", F.spark_partition_id().alias("_part"), row.alias("_row")), deps=F.sum(F.size("deps")))
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    shift, total = [], 0
    for part, n in sizes:
        shift.append((part, total))
        total += n
    shifts = targets.sparkSession.createDataFrame(shift, "_part int, _shift long")
    return ranged.join(F.broadcast(shifts), "_part").select((F.col("_shift") + F.col("_row")).alias("id"), *targets.columns), facts


def graph(targets: DataFrame) -> Numbered:
    """targets: name, deps and further columns, which nodes keep."""
    nodes, facts = number(targets)
    kept = [c for c in targets.columns if c != "deps"]
    asked = nodes.select(F.col("id").alias("src"), F.posexplode("deps").alias("ord", "_name")).where("_name <> ''")
    edges = asked.join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("_name")), "_name").select("src", "dst", "ord")
    buckets = max(targets.sparkSession.sparkContext.defaultParallelism, -(-(facts["deps"] or 0) // BUCKET_EDGES))
    return Numbered(nodes.select("id", *kept), bucketed(edges, "dst", buckets), buckets)


def spread(links: DataFrame, start: DataFrame, buckets: int | None = None) -> DataFrame:
    """id, level of all that start (id) leads to over links (a, b), which are best stored in buckets of a. Levels are stored in
    as many buckets: what was found already isn't shuffled again. forget() deletes them."""
    buckets = buckets or links.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df: df.select("id").repartition(buckets, "id").distinct()
    frontier, facts = counted_buckets(dealt(start), "id", buckets, dealt=True)
    found, level, stored = [frontier.select("id", F.lit(0).alias("level"))], 0, [frontier]
    while facts["n"]:
        level += 1
        near = F.broadcast(frontier) if facts["n"] <= BROADCAST_NODES else frontier
        step = dealt(links.join(near.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")))
        for f in found:
            step = step.join(f.select("id"), "id", "left_anti")
        frontier, facts = counted_buckets(step, "id", buckets, dealt=True)
        stored.append(frontier)
        found.append(frontier.select("id", F.lit(level).alias("level")))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return keeping(out, *stored)


def levels(g: Numbered, settled: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[int]]:
    """id, level: 0 for settled (id) nodes and those without dependencies, else one more than the highest of the
    dependencies; ids of the rest, which reach a cycle of others; and the number of nodes of each level. Each node waits with the number
    of its dependencies; a level's nodes are counted off over the edges to them."""
    degree = g.inverse.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    state = g.nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    if settled is not None:
        state = state.join(settled.select("id", F.lit(True).alias("_settled")), "id", "left").select("id", F.when(F.col("_settled"), 0).otherwise(F.col("n")).alias("n"))
    state, facts = counted(state, done=F.count_if(F.col("n") == 0))
    found, sizes, waiting = [], [], facts["n"]
    while facts["done"]:
        newest = state.where("n = 0").select("id")
        near = F.broadcast(newest) if facts["done"] <= BROADCAST_NODES else newest
        found.append(newest.select("id", F.lit(len(found)).alias("level")))
        sizes.append(facts["done"])
        waiting -= facts["done"]
        if not waiting:
            break
        got = g.inverse.join(near.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("c"))
        left = state.where("n > 0").join(got, "id", "left").select("id", (F.col("n") - F.coalesce("c", F.lit(0))).alias("n"))
        state, facts = counted(left, done=F.count_if(F.col("n") == 0))
    out = state.where("n < 0").select("id", F.lit(0).alias("level"))
    for f in found:
        out = out.union(f)
    rest = state.where("n > 0").select("id")
    return out, rest, sizes
