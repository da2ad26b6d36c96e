"""Whole folders as entries for parsers.directory_hashes(): walked by the executors where these share a file system, or made
of what Spark's binaryFile source read; paths cleaned, links made relative."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from targetry.sources.parsers import blob_hash


def _segments(path: Column) -> Column:
    """A path's names from the top, where `.` and empty names are left out and `..` takes back the name before; at the top of
    an absolute path it is nothing, of a relative one it stays."""
    rooted = F.startswith(path, F.lit("/"))
    none = F.array().cast("array<string>")

    def step(done: Column, name: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
        up = F.when(last != "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done)
        return F.when(name == "..", F.coalesce(up, F.concat(done, F.array(name)))).otherwise(F.concat(done, F.array(name)))

    names = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    return F.aggregate(names, none, step)


def clean(path: Column) -> Column:
    """The shortest path of the same meaning, by its text alone; `.` for the folder itself."""
    joined = F.array_join(_segments(path), "/")
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", F.lit(".")).otherwise(joined))


def relative(folder: Column, path: Column) -> Column:
    """The way from an absolute folder to an absolute path."""
    base, names = _segments(folder), _segments(path)
    # names in common at the beginning: before the first place where they differ
    differ = F.array_position(F.zip_with(base, names, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    common = F.when(differ > 0, differ - 1).otherwise(F.least(F.size(base), F.size(names))).cast("int")
    ups = F.array_repeat(F.lit(".."), F.size(base) - common)
    way = F.array_join(F.concat(ups, F.slice(names, common + 1, F.greatest(F.size(names) - common, F.lit(0)))), "/")
    return F.when(way == "", F.lit(".")).otherwise(way)


def link_target(link: Column, target: Column) -> Column:
    """What a link at an absolute path leads to, relative to its folder, so that it doesn't depend on where the tree lies."""
    folder = F.regexp_replace(link, "(?s)/[^/]*$", "")
    return F.when(F.startswith(target, F.lit("/")), relative(F.concat(folder, F.lit("/")), target)).otherwise(clean(target))


def entries(roots: DataFrame, files: DataFrame, links: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """directory, path, kind, hash, link of all that lies under each root, as parsers.directory_hashes() takes it.

    roots: directory (absolute). files: path (absolute, with or without `file:`), content, as the binaryFile source gives
    them; it leaves out files that are empty or whose names begin with `_` or `.`, which have to be added. links: path, target of links, which that source follows: what it found at or under one is left out. folders: path
    of folders, needed only for those without entries. Roots may lie within others; a root without anything in it gives nothing.
    """
    spark = roots.sparkSession
    plain = lambda c: clean(F.regexp_replace(c, "^[a-z]+:/+", "/"))
    tops = roots.select(plain(F.col("directory")).alias("directory")).distinct()
    links = links if links is not None else spark.createDataFrame([], "path string, target string")
    one = files.select(plain(F.col("path")).alias("path"), F.lit("file").alias("kind"), blob_hash(F.col("content")).alias("hash"), F.lit(None).cast("string").alias("link"))
    lead = links.select(plain(F.col("path")).alias("path"), F.lit("symlink").alias("kind"), F.lit(None).cast("string").alias("hash"), F.col("target").alias("link"))
    lead = lead.withColumn("link", link_target(F.col("path"), F.col("link")))
    empty = one.limit(0) if folders is None else folders.select(plain(F.col("path")).alias("path"), F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("link"))

    def above(rows: DataFrame) -> DataFrame:
        """Each row with each folder above it, and itself, as over."""
        parts = F.split("path", "/")
        return rows.withColumn("over", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))

    hidden = above(one.union(empty)).join(lead.select(F.col("path").alias("over")), "over").select("path").distinct()
    real = one.union(empty).join(hidden, "path", "left_anti").union(lead)
    under = above(real).where("over <> path").join(tops.withColumnRenamed("directory", "over"), "over").withColumnRenamed("over", "directory")
    inside = under.select("directory", F.expr("substring(path, length(directory) + 2)").alias("path"), "kind", "hash", "link")
    # folders on the way to each entry
    parts = F.split("path", "/")
    between = inside.where(F.size(parts) > 1).select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path"))
    way = between.select("directory", "path", F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("link"))
    return inside.union(way).distinct()


_ENTRY = "directory string, path string, kind string, hash string, link string"


def walked(roots: DataFrame) -> DataFrame:
    """The same entries of folders that all executors see under the same path. roots: directory (absolute). What lies at the
    top of each root is walked in tasks of its own; files are hashed piece by piece. Something other than a file, a folder
    or a link is of kind special, which directory_hashes() refuses. A root that isn't a folder is an error."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in batch.column(0).to_pylist():
                names = sorted(os.listdir(root))
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(names), pa.string()), pa.array(names, pa.string())], names=["directory", "name"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(c.split()[0], pa.string()) for c in _ENTRY.split(", ")])
        for batch in batches:
            held = []
            for row in batch.to_pylist():
                for entry in _under(row["directory"], row["name"]):
                    held.append(entry)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held = []
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    plain = roots.select(clean(F.regexp_replace("directory", "^file:/+", "/")).alias("directory")).distinct()
    listed = plain.mapInArrow(tops, "directory string, name string")
    return listed.repartition("directory", "name").mapInArrow(walk, _ENTRY)


def _under(root: str, name: str) -> Iterator[dict[str, str | None]]:
    """An entry and all below it."""
    todo = [name]
    while todo:
        path = todo.pop()
        whole, entry = os.path.join(root, path), {"directory": root, "path": path}
        if os.path.islink(whole):
            target = os.readlink(whole)
            target = os.path.relpath(target, os.path.dirname(whole)) if os.path.isabs(target) else os.path.normpath(target)
            yield entry | {"kind": "symlink", "link": target}
        elif os.path.isdir(whole):
            yield entry | {"kind": "directory"}
            todo += [f"{path}/{n}" for n in os.listdir(whole)]
        elif os.path.isfile(whole):
            found = hashlib.sha1(b"blob %d\0" % os.path.getsize(whole))
            with open(whole, "rb") as file:
                while piece := file.read(1 << 20):
                    found.update(piece)
            yield entry | {"kind": "file", "hash": found.hexdigest()}
        else:
            yield entry | {"kind": "special"}
