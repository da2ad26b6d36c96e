"""A stored graph kept up to date by a stream of targets of changed packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from targetry.functions.labels import package_of
from targetry.operators import diff, incremental
from targetry.sources import stored
from targetry.sources.tables import store


def maintain(updates: DataFrame, base: str, head: str = "head") -> DataStreamWriter:
    """Each batch of updates becomes a version of the graph under base, with its diff to the version before.

    updates (streaming): name, own, deps, rule_type of all targets of the packages that changed; a package whose only row
    has a null name in it is gone (package has to be given for such rows). The first version is put under
    `graphs/none` by the caller. A batch that is repeated after a failure starts from the same version again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if stored.get(spark, base, f"diffs/{number}") is not None and stored.pointer(spark, base, head) == f"graphs/{number}":
            return
        last = stored.pointer(spark, base, f"before/{number}") or stored.pointer(spark, base, head) or "graphs/none"
        stored.put_pointer(spark, base, f"before/{number}", last)
        previous = stored.get(spark, base, last)
        rows = store(batch)
        fresh = rows.where("name IS NOT NULL").select(*[F.lit(None).cast("string").alias("hash") if c == "hash" else F.col(c) for c in previous.columns])
        packages = rows.select(F.coalesce("package", package_of(F.col("name"))).alias("package")).distinct()
        gone = packages.join(fresh.select(package_of(F.col("name")).alias("package")), "package", "left_anti")
        updated = store(incremental.update(previous, fresh, packages.join(gone, "package", "left_anti"), gone))
        stored.put(updated, base, f"graphs/{number}")
        stored.put(diff.narrow(previous, updated), base, f"diffs/{number}")
        stored.put_pointer(spark, base, head, f"graphs/{number}")

    return updates.writeStream.foreachBatch(step)
