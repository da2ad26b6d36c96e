"""Prefix sums, histograms and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from targetry.operators.diff import CHANGED, DELETED, NEW, edges
from targetry.sources.tables import store


def prefix_sums(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """rows with before: the sum of value over all earlier rows. Summed within ranges of the order, which tells all rows
    apart, and shifted by the ranges before."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = store(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    shift = ranged.groupBy("_part").agg(F.sum(value).alias("s")).select("_part", F.coalesce(F.sum("s").over(earlier(W.orderBy("_part"))), F.lit(0)).alias("_shift"))
    inside = F.coalesce(F.sum(value).over(earlier(W.partitionBy("_part").orderBy(*order))), F.lit(0))
    return ranged.join(F.broadcast(shift), "_part").select(*rows.columns, (F.col("_shift") + inside).cast("long").alias("before"))


def degree_offsets(targets: DataFrame) -> DataFrame:
    """name, degree, before: where a target's dependencies begin in a list of all, targets in order of name."""
    degree = edges(targets).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("degree"))
    rows = targets.select("name").join(degree, "name", "left").select("name", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    return prefix_sums(rows, "degree", "name")


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """bound, n: how many values are at most each bound, and all of them for the bound of infinity. Nulls don't count."""
    ends = [*bounds, float("inf")]
    one = rows.where(F.col(value).isNotNull()).agg(*[F.count_if(F.col(value) <= b).alias(f"n{i}") for i, b in enumerate(ends)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"n{i}").alias("n")) for i, b in enumerate(ends)])).alias("x")).select("x.*")


def counters(changed: DataFrame) -> DataFrame:
    """One row: targets by change type, seeds, reached and unreached, and the furthest distance. changed: change_type,
    is_seed, distance."""
    kind = lambda k: F.count_if(F.col("change_type") == k)
    return changed.agg(
        kind(NEW).alias("n_new"), kind(DELETED).alias("n_deleted"), kind(CHANGED).alias("n_changed"), F.count_if("is_seed").alias("n_seeds"),
        F.count_if(F.col("distance") > 0).alias("n_reached"), F.count_if(F.col("distance") < 0).alias("n_unreached"), F.max("distance").alias("levels"),
    )
