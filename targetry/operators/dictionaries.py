"""Dictionaries of dense ids, their resolution, and merging of chunked responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from targetry.sources.tables import store


def dense_ids(names: DataFrame, first: int = 1) -> DataFrame:
    """name, id: distinct names numbered in order from first.

    Names are dealt by ranges, numbered within a range, and shifted by the sizes of the ranges before: no single task
    sorts all.
    """
    spark = names.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = store(names.select("name").distinct().repartitionByRange(parts, "name").sortWithinPartitions("name").withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy("name"))
    return ranged.join(F.broadcast(shift), "_part").select("name", (F.col("_shift") + inside - 1 + first).cast("int").alias("id"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: that of the latest chunk and position."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return newest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def resolve(targets: DataFrame, names: DataFrame, rule_types: DataFrame) -> DataFrame:
    """Id-mapped targets (id, hash, deps array<int>, rule_type int) with names instead. names, rule_types: id, name.

    A target without a name is dropped, a dependency without one too; a rule type without one is empty.
    """
    deps = targets.select("id", F.posexplode("deps").alias("ord", "dep")).join(names.select(F.col("id").alias("dep"), F.col("name").alias("dep_name")), "dep")
    deps = deps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dep_name"))), lambda x: x["dep_name"]).alias("deps"))
    kinds = rule_types.select(F.col("id").alias("rule_type"), F.col("name").alias("kind"))
    out = targets.drop("deps").join(names, "id").join(deps, "id", "left").join(kinds, "rule_type", "left")
    return out.select("name", "hash", F.coalesce("kind", F.lit("")).alias("rule_type"), F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))
