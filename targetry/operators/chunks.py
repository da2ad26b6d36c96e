"""Greedy chunks of bounded size over a whole ordered table.

A new chunk begins where the next row would exceed the bound; a larger row is a chunk of its own. Rows are dealt by ranges
of their order. For each row that may begin the first new chunk of a range, the range works out how many chunks follow and
how full the last one is; a pass over these summaries, one range after another, fixes what each range begins with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.sources.tables import store

_FACTS = "part int, total long, first array<long>, follow array<long>, last array<long>"


def _follow(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of sizes before each row (and of all), and the row that begins the chunk after one that begins at each row."""
    sums = np.append(0, np.cumsum(sizes))
    after = np.searchsorted(sums, sums[:-1] + most, "right") - 1
    return sums, np.maximum(after, np.arange(len(sizes)) + 1)


def numbered(rows: DataFrame, size: str, most: int, *order: str) -> DataFrame:
    """rows with chunk_no (from 0). order has to tell all rows apart."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = store(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))

    def facts(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order))
        sums, after = _follow(frame[size].to_numpy(np.int64), most)
        n = len(frame)
        count, last = np.ones(n, np.int64), sums[n] - sums[:n]
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                count[i], last[i] = count[after[i]] + 1, last[after[i]]
        some = min(n, int(np.searchsorted(sums, most, "right")) + 1)  # rows that the open chunk may leave first
        return pd.DataFrame({"part": [frame["_part"].iloc[0]], "total": [sums[n]], "first": [sums[:some]], "follow": [count[:some]], "last": [last[:some]]})

    found = store(held.select("_part", size, *[c for c in order if c != size]).groupBy("_part").applyInPandas(facts, _FACTS))
    begins, chunk, open_ = [], -1, None  # the chunk that is open, and its bytes
    for r in found.orderBy("part").toLocalIterator():
        begins.append((r.part, chunk, open_))
        fits = 0 if open_ is None else int(np.searchsorted(np.array(r.first), most - open_, "right")) - 1
        fits = max(fits, 0)
        if open_ is not None and r.total <= most - open_:
            open_ += r.total
        else:
            chunk, open_ = chunk + r.follow[fits], r.last[fits]
    starts = {p: (c, o) for p, c, o in begins}

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(list(order))
        now, filled = starts[int(frame["_part"].iloc[0])]
        sums, after = _follow(frame[size].to_numpy(np.int64), most)
        at = 0 if filled is None else max(0, int(np.searchsorted(sums, most - filled, "right")) - 1)
        number = np.full(len(frame), now, np.int64)
        while at < len(frame):
            now += 1
            number[at : after[at]] = now
            at = int(after[at])
        return frame.drop(columns="_part").assign(chunk_no=number)

    schema = rows.select("*", F.lit(0).cast("long").alias("chunk_no")).schema
    return held.groupBy("_part").applyInPandas(deal, schema)
