"""Incremental maintenance: changed packages are replaced, and only what depends on them is hashed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.functions.labels import package_of
from targetry.operators import merkle
from targetry.operators.diff import edges
from targetry.sources.tables import bucket_count, bucketed, forget, keeping, store


def deleted(previous: DataFrame, fresh: DataFrame, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """name of previous targets in a package that is gone, or in a changed one but not in its fresh rows."""
    own = previous.select("name", package_of(F.col("name")).alias("package"))
    return own.join(gone.select("package"), "package", "left_semi").select("name").union(
        own.join(changed.select("package"), "package", "left_semi").join(fresh.select("name"), "name", "left_anti").select("name")
    )


def united(*scans: DataFrame) -> DataFrame:
    """One table of several scans of a graph, by column names; a column that a scan lacks is null. A target that several scans
    have comes from the first of them."""
    rows = None
    for k, scan in enumerate(scans):
        part = scan.withColumn("_scan", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in ("name", "_scan")]
    first = rows.groupBy("name").agg(F.min_by(F.struct(*others), "_scan").alias("_row"))
    return first.select("name", *[F.col(f"_row.{c}").alias(c) for c in others])


def update(previous: DataFrame, fresh: DataFrame, changed: DataFrame, gone: DataFrame, strict: bool = True, sequential: tuple[str, ...] = ()) -> DataFrame:
    """previous (name, hash, own, deps, ...) with the rows of changed packages replaced by fresh ones and re-hashed.

    changed, gone: package. fresh has the columns of previous; its hash is not read. With strict, a dependency of a
    fresh row that exists nowhere is an error. Of cycles, sequential targets are hashed first. A root column is worked out
    anew, since targets may lose their last dependent or get a first one.

    A walk column (array, null where it is the dependencies) has what a target is hashed over instead: labels of other
    repositories walk to their `//external:` rule alone, so that a fresh rule re-hashes them and what depends on them. Such
    rules are replaced like other rows: their package is `external`.
    """
    lost = store(deleted(previous, fresh, changed, gone))
    kept = previous.join(lost, "name", "left_anti").join(fresh.select("name"), "name", "left_anti")
    rows = store(kept.select(*previous.columns, F.lit(False).alias("_fresh")).union(fresh.select(*[F.lit(None).cast("string").alias("hash") if c == "hash" else F.col(c) for c in previous.columns], F.lit(True))))
    if strict:
        dangling = edges(rows.where("_fresh")).select(F.col("dst").alias("name")).join(rows.select("name"), "name", "left_anti")
        if not dangling.isEmpty():
            raise ValueError(f"unknown dependency {dangling.first().name}")
    start = rows.where("_fresh").select("name").union(lost)
    walk = F.coalesce("walk", "deps") if "walk" in previous.columns else F.col("deps")
    walked = rows.withColumn("deps", walk)
    links, buckets = edges(walked), bucket_count(rows)
    found = merkle.reach(links.select(F.col("dst").alias("a"), F.col("src").alias("b")), start, buckets)
    stale = store(found.join(rows.select("name"), "name", "left_semi"))
    forget(found)
    marked = walked.join(stale.select("name", F.lit(True).alias("_stale")), "name", "left")
    plain = marked.select("name", "own", "deps", "rule_type", F.when(F.col("_stale").isNull(), F.col("hash")).alias("fixed"))
    plain = bucketed(plain, "name", buckets)
    forget(stale)
    hashes = merkle.hash_graph(plain, sequential)
    out = rows.drop("hash", "_fresh").join(hashes, "name")
    if "root" in previous.columns:
        found = merkle.roots(rows).select("name", F.lit(True).alias("_root"))
        out = out.drop("root").join(found, "name", "left").withColumn("root", F.coalesce("_root", F.lit(False)))
    return keeping(out.select(*previous.columns), hashes, plain, rows, lost)
