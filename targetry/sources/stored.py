"""Results under content keys in a folder that all machines share: graphs, diffs, and pointers to graphs."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from targetry.sources.tables import exists


def put(df: DataFrame, base: str, key: str) -> None:
    """Rows under the key; what was there is replaced. Sorted by name within files, where there is a name."""
    rows = df.sortWithinPartitions("name") if "name" in df.columns else df
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{key}")


def get(spark: SparkSession, base: str, key: str) -> DataFrame | None:
    """The rows under the key; None if there are none, if their writing wasn't finished, or if a file is broken."""
    path = f"{base}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        return None
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)  # reads all footers
    except (PySparkException, Py4JJavaError):
        return None


def whole(spark: SparkSession, base: str, key: str) -> DataFrame | None:
    """The rows under the key after each was read once by the executors: None also if a page within a file is broken."""
    found = get(spark, base, key)
    if found is None:
        return None
    try:
        found.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError):
        if not _readable(spark):
            raise
        return None
    return found


def _readable(spark: SparkSession) -> bool:
    """Whether jobs run at all: a cancelled request's don't."""
    try:
        return spark.range(1).count() == 1
    except (PySparkException, Py4JJavaError):
        return False


def cached(spark: SparkSession, base: str, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The rows under the key, computed and put there if they are missing or broken."""
    found = get(spark, base, key)
    if found is None:
        put(compute(), base, key)
        found = get(spark, base, key)
        if found is None:
            raise OSError(f"{base}/{key} can't be read after it was written")
    return found


def put_pointer(spark: SparkSession, base: str, key: str, value: str) -> None:
    """A short text under the key, such as the tree hash of a build description."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base}/{key}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(value.encode()))
    finally:
        out.close()


def pointer(spark: SparkSession, base: str, key: str) -> str:
    """The text under the key; empty if there is none."""
    if not exists(spark, f"{base}/{key}"):
        return ""
    return spark.read.text(f"{base}/{key}", wholetext=True).first()[0]
