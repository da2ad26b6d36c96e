"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Stored bytes of a range.
RANGE_BYTES = 32 << 20
#: Stored bytes of a bucket.
BUCKET_BYTES = 16 << 20
#: Spark's setting by which a query's shuffle files go when it ends, not when the driver's garbage happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_stored: set[tuple[SparkSession, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
        path = "file://" + tempfile.mkdtemp(prefix="targetry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def store(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as Parquet and read again: cuts the lineage of a loop and survives lost executors. by: a column of few
    values, each of which gets files of its own."""
    path = f"{shared_dir(df.sparkSession)}/targetry-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with cleaning(df.sparkSession):
        (writer.partitionBy(by) if by else writer).parquet(path)
    _stored.add((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._targetry_path = path
    return out


def counted(df: DataFrame, **facts: Column) -> tuple[DataFrame, dict[str, int]]:
    """store(df), and n, the number of its rows, with further facts about them: aggregates that are observed by the job that
    writes them. Null where there are no rows."""
    seen = Observation()
    out = store(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in facts.items()]))
    return out, seen.get


def range_count(df: DataFrame) -> int:
    """Ranges to deal df into: of a stored table by its bytes, else as many as Spark shuffles to."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not hasattr(df, "_targetry_path"):
        return least
    return max(least, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // RANGE_BYTES))


def bucket_count(df: DataFrame) -> int:
    """Buckets to deal df into: of a stored table by its bytes, as many as there are cores at least."""
    least = df.sparkSession.sparkContext.defaultParallelism
    if hasattr(df, "_targetry_buckets"):
        return df._targetry_buckets[1]
    if not hasattr(df, "_targetry_path"):
        return least
    return max(least, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // BUCKET_BYTES))


def bucketed(df: DataFrame, key: str, buckets: int, dealt: bool = False, by: str | None = None) -> DataFrame:
    """df stored in buckets of a column: joins on it shuffle the other side alone, or nothing if that has as many buckets.
    dealt: df's rows lie as repartition(buckets, key) would deal them. by: as for store()."""
    name = f"targetry_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    with cleaning(df.sparkSession):
        writer = (df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).saveAsTable(name)
    _stored.add((df.sparkSession, path))
    out = df.sparkSession.table(name)
    out._targetry_path, out._targetry_table, out._targetry_buckets = path, name, (key, buckets)
    return out


def counted_buckets(df: DataFrame, key: str, buckets: int, dealt: bool = False, by: str | None = None, **facts: Column) -> tuple[DataFrame, dict[str, int]]:
    """bucketed(df), and n and further facts as counted() has them."""
    seen = Observation()
    rows = (df if dealt else df.repartition(buckets, key)).observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in facts.items()])
    return bucketed(rows, key, buckets, dealt=True, by=by), seen.get


def keeping(df: DataFrame, *frames: DataFrame) -> DataFrame:
    """df, which reads stored frames: forget(df) deletes these."""
    df._targetry_parts = [*getattr(df, "_targetry_parts", ()), *frames]
    return df


def forget_part(df: DataFrame, by: str, value: str) -> None:
    """Deletes the rows of a table stored by a column that have this value; they may not be read any more."""
    delete(df.sparkSession, f"{df._targetry_path}/{by}={value}")


def forget(*frames: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in frames:
        forget(*getattr(df, "_targetry_parts", ()))
        path = getattr(df, "_targetry_path", None)
        if path:
            if hasattr(df, "_targetry_table"):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._targetry_table}")
            delete(df.sparkSession, path)
            _stored.discard((df.sparkSession, path))


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, null if there is none; read by Hadoop's file system, without a job."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is seen as a whole or not at all: written beside its place, then renamed."""
    jvm = spark.sparkContext._jvm
    p, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    files.delete(p, False)
    if not files.rename(beside, p):
        raise OSError(f"{path} can't be written")


@atexit.register
def _clean() -> None:
    for spark, path in list(_stored):
        try:
            if (name := path.rsplit("/", 1)[-1]).startswith("targetry_"):
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(spark, path)
        except Exception:  # the session may be gone
            return
