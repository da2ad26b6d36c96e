"""Which package a file belongs to, and which packages a list of changed files touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from targetry.functions.labels import containing_packages
from targetry.operators.changes import BUILD, Patterns, category
from targetry.sources.tables import store


def folder(path: Column) -> Column:
    """What stands before a path's last slash; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "(?s)/[^/]*$", "")).otherwise(F.lit(""))


def containing(paths: DataFrame, packages: DataFrame, strict: bool = True) -> DataFrame:
    """paths (path, ...) with package, the nearest folder above each that is one of packages (package). Without one: an error
    if strict, else null; a null path has none. Columns named package or of a leading underscore are replaced.

    Each folder with files is looked up once: its ancestors are joined with the packages, and the longest that is one stays.
    The top folder, an ancestor of all, takes no part in the join.
    """
    known = packages.select(F.col("package").alias("_above")).where("_above IS NOT NULL").distinct()
    top = F.lit("") if not known.where("_above = ''").isEmpty() else F.lit(None).cast("string")
    rows = paths.drop("package").withColumn("_folder", folder(F.col("path")))
    # "x" stands for any file in the folder
    above = rows.select("_folder").distinct().select(F.col("_folder").alias("_of"), F.explode(containing_packages(F.concat("_folder", F.lit("/x")))).alias("_above"))
    found = above.where("_above <> ''").join(known, "_above").groupBy("_of").agg(F.max_by("_above", F.length("_above")).alias("package"))
    out = rows.join(found, F.col("_folder") == F.col("_of"), "left")
    package = F.coalesce("package", F.when(F.col("path").isNotNull(), top))
    if strict:
        package = F.when(package.isNull(), F.raise_error(F.concat(F.lit("no package contains "), F.coalesce("path", F.lit("a null path")))).cast("string")).otherwise(package)
    return out.withColumn("package", package).drop("_folder", "_of")


def touched(changes: DataFrame, packages: DataFrame, patterns: Patterns = Patterns()) -> tuple[DataFrame, DataFrame]:
    """Packages to read anew and packages that are gone, as incremental.update() takes them. changes: status (one letter),
    path; packages: those there were.

    A deleted build file ends its package, whose files then belong to the package above; a new one begins a package, which
    takes files from the one above. Both change the package above, and each file changes its own. Files outside of
    packages change none.
    """
    kinds = changes.select("status", "path", category(F.col("path"), patterns).alias("kind"), folder(F.col("path")).alias("package"))
    build = store(kinds.where(F.col("kind") == BUILD).groupBy("package").agg(F.bool_and(F.col("status") == "D").alias("gone"), F.bool_or(F.col("status").isin("A", "D", "R", "C")).alias("moved")))
    old = packages.select("package").where("package IS NOT NULL").distinct()
    gone = store(build.where("gone").select("package").join(old, "package", "left_semi"))
    now = store(old.join(gone, "package", "left_anti").union(build.where("NOT gone").select("package")).distinct())
    # the package above a folder is that of a file beside it
    around = build.where("moved AND package <> ''").select(F.col("package").alias("path"))
    changed = containing(kinds.select("path").union(around), now, strict=False).where("package IS NOT NULL").select("package").distinct()
    return changed, gone
