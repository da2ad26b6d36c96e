"""Floor (as-of) lookup of stored snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def floor(snapshots: DataFrame, remote: str, ts: int) -> DataFrame:
    """The snapshot of the remote with the greatest (commit_ts, sha) at or before ts; no row if there is none."""
    best = snapshots.where((F.col("remote") == remote) & (F.col("commit_ts") <= ts)).agg(F.max(F.struct("commit_ts", "sha")).alias("s"))
    return best.where("s IS NOT NULL").select("s.*")


def floor_join(probes: DataFrame, snapshots: DataFrame, by: str, bucket: int = 1 << 20) -> DataFrame:
    """probes (by, ts, ...) with commit_ts and sha of their floor snapshot (null if none).

    Both sides are sorted together by key and time within buckets of time, so a key with many rows is split; the last
    snapshot before a bucket is carried over from a table with a row for each key and bucket.
    """
    others = [c for c in probes.columns if c not in (by, "ts")]
    part = F.floor(F.col("ts") / bucket)
    left = probes.select(by, "ts", F.struct(*others).alias("probe"), F.lit(None).cast("struct<commit_ts:bigint,sha:string>").alias("snap"))
    right = snapshots.select(by, F.col("commit_ts").alias("ts"), F.lit(None).cast(left.schema["probe"].dataType).alias("probe"), F.struct(F.col("commit_ts").cast("bigint"), "sha").alias("snap"))
    rows = left.union(right).withColumn("_part", part)
    # of equal times snapshots come before probes, and by sha among themselves
    w = W.partitionBy(by, "_part").orderBy("ts", F.col("snap").isNull().cast("int"), F.col("snap.sha")).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("_by").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.max("snap").alias("_last")).withColumn("_carried", F.max("_last").over(earlier)).drop("_last")
    seen = rows.withColumn("floor", F.last("snap", ignorenulls=True).over(w)).where("snap IS NULL")
    seen = seen.join(carried, F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_of")), "left").withColumn("floor", F.coalesce("floor", "_carried"))
    return seen.select(by, "ts", *[F.col(f"probe.{c}").alias(c) for c in others], F.col("floor.commit_ts").alias("commit_ts"), F.col("floor.sha").alias("sha"))
