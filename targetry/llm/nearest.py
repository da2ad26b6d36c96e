"""Nearest neighbours by a block matrix join: vectors are coded as int8 with a scale of their own and packed into blocks;
a tile multiplies a block of queries with a block of vectors in whole numbers. The coded vectors' distance, less and plus
the norms of both coding errors, bounds the distance itself; only pairs whose lower bound doesn't exceed the k-th best so
far are computed again from the original vectors in double precision, and heaps keep the k best of each query.

Results are exact: an error bound drops no neighbour. Queries and vectors are dealt into stripes of bounded size; each pair
of stripes is one group of the join, whatever the values of the vectors, and hands on k rows a query.

Odd cases. Vectors that are null, empty or zero or hold null or non-finite components take no part, and neither do rows
without id. Vectors of another length than the query's are no neighbours of it. Rows with the query's own id are left out;
other repeated rows count each. Queries repeated as a whole are answered once; several vectors of one query id are answered
each. Ties go to the smaller id. A distance beyond the largest double is infinite, and comes last. An empty table gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from targetry.llm.common import forget, lean, store

#: Bytes of a block's vectors in doubles, and of a stripe's.
BLOCK_BYTES = 1 << 20
STRIPE_BYTES = 1 << 26
#: Pairs that are computed again at once.
PAIRS = 1 << 17
#: Products of so many components are exact in single precision: 1024 * 127 * 127 < 2**24.
EXACT = 1024
BLOCK = "d int, n int, ids binary, marks binary, vectors binary, codes binary, scales binary, errors binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes from -127 to 127, scale and norm of what is left, by row. x is about scale * code."""
    scale = np.abs(x).max(1) / 127
    with np.errstate(all="ignore"):
        codes = np.clip(np.rint(np.where(scale[:, None] > 0, x / scale[:, None], 0)), -127, 127).astype(np.int8)
        error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9)
    return codes, scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two int8 matrices."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance by row, squares summed one component after another."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for k in range(a.shape[1]):
            gap = a[:, k] - b[:, k]
            total += gap * gap
        return np.sqrt(total)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, v) as blocks of vectors of one length."""
    held: dict[int, list] = {}

    def flush(d: int) -> pa.RecordBatch:
        ids, marks, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
        codes, scales, errors = quantise(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int32()), pa.array([len(ids)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (ids, marks, x, codes, scales, errors))],
            names=["d", "n", "ids", "marks", "vectors", "codes", "scales", "errors"],
        )

    for batch in batches:
        v = batch.column(2)
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            own = batch.filter(pa.array(sizes == d))
            x = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            ids, marks = (own.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            most = max(1, BLOCK_BYTES // (8 * int(d)))
            for k in range(0, len(ids), most):
                held.setdefault(d, []).append((ids[k : k + most], marks[k : k + most], x[k : k + most]))
                if sum(len(c[0]) for c in held[d]) >= most:
                    yield flush(d)
    for d in list(held):
        yield flush(d)


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, marks, vectors, codes, scales, errors of each block."""
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            d, n = batch.column("d")[i].as_py(), batch.column("n")[i].as_py()
            read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
            yield read("ids", np.int64), read("marks", np.int64), read("vectors", np.float64).reshape(n, d), read("codes", np.int8).reshape(n, d), read("scales", np.float64), read("errors", np.float64)


def _stripes(k: int):
    def work(asked: pa.Table, table: pa.Table) -> pa.Table:
        vectors = list(_blocks(table))
        out = []
        for ids, marks, x, codes, scales, errors in _blocks(asked) if vectors else ():
            heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
            worst = np.full(len(ids), np.inf)
            for other in vectors:
                _tile(ids, x, codes, scales, errors, other, heaps, worst, k)
            out += [(q, m, -i, -s) for q, m, heap in zip(ids.tolist(), marks.tolist(), heaps, strict=True) for s, i in heap]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "mark", "id", "distance"])

    return work


def _tile(ids, x, codes, scales, errors, other, heaps, worst, k) -> None:
    """Takes a block's vectors into the heaps of a block of queries. A heap has negative distances and ids, the worst first."""
    o_ids, _, o_x, o_codes, o_scales, o_errors = other
    square = lambda c, s: (c.astype(np.float64) ** 2).sum(1) * s * s
    with np.errstate(all="ignore"):
        a, b = square(codes, scales), square(o_codes, o_scales)
        between = a[:, None] + b - 2 * (products(codes, o_codes) * scales[:, None] * o_scales)
        between = np.sqrt(np.maximum(between, 0))
        slack = errors[:, None] + o_errors + 1e-7 * (np.sqrt(a)[:, None] + np.sqrt(b))  # the last for rounding
        lower, upper = between - slack, between + slack
    wild = ~np.isfinite(lower) | ~np.isfinite(upper)
    lower[wild], upper[wild] = -np.inf, np.inf
    own = ids[:, None] == o_ids
    lower[own], upper[own] = np.inf, np.inf
    bound = worst
    if upper.shape[1] > k:
        bound = np.minimum(worst, np.partition(upper, k - 1, axis=1)[:, k - 1])
    q, c = np.nonzero((lower <= bound[:, None]) & ~own)
    for at in range(0, len(q), PAIRS):
        some_q, some_c = q[at : at + PAIRS], c[at : at + PAIRS]
        found = distance(x[some_q], o_x[some_c])
        good = np.flatnonzero(found <= worst[some_q])
        good = good[np.lexsort((o_ids[some_c[good]], found[good]))]  # nearest first, so that most others don't enter
        for i, s, v in zip(some_q[good].tolist(), found[good].tolist(), o_ids[some_c[good]].tolist(), strict=True):
            heap = heaps[i]
            if len(heap) < k:
                heapq.heappush(heap, (-s, -v))
            elif (-s, -v) > heap[0]:
                heapq.heapreplace(heap, (-s, -v))
            if len(heap) == k:
                worst[i] = -heap[0][0]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query, rank (from 1), key and distance of the k nearest vectors of each query; key holds whole numbers."""
    spark = vectors.sparkSession
    lean(spark)
    v = F.col(embedding).cast("array<double>")
    fine = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = lambda df: df.where(fine).select(F.col(key).cast("long").alias("id"), F.xxhash64(v).alias("mark"), v.alias("v"))
    packed = lambda df: store(df.mapInArrow(_packed, BLOCK).withColumn("at", F.spark_partition_id() + (F.monotonically_increasing_id() % (1 << 33))))
    table, asked = packed(rows(vectors)), packed(rows(queries).distinct())
    size = lambda df: df.agg(F.coalesce(F.sum(F.col("n").cast("long") * F.col("d") * 8), F.lit(0))).first()[0]
    n_table, n_asked = size(table), size(asked)
    down = max(1, -(-n_asked // STRIPE_BYTES))
    across = max(1, -(-n_table // STRIPE_BYTES), min(spark.sparkContext.defaultParallelism, -(-n_table // BLOCK_BYTES)))
    dealt = lambda df, own, n_own, each, n_each: df.withColumn(own, F.col("at") % n_own).withColumn(each, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_each - 1).cast("long"))))
    left, right = dealt(asked, "row", down, "col", across), dealt(table, "col", across, "row", down)
    best = store(left.groupBy("row", "col", "d").cogroup(right.groupBy("row", "col", "d")).applyInArrow(_stripes(k), "query long, mark long, id long, distance double"))
    forget(table, asked)
    order = Window.partitionBy("query", "mark").orderBy("distance", "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", F.col("id").alias(key), "distance")
