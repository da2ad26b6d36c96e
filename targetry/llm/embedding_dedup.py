"""Near-duplicate embeddings by lattice hashing: each of TABLES random projections to 8 dimensions is decoded to the
nearest point of the E8 lattice; vectors meet in the cell of one and one of the PROBES neighbouring cells (or the own
cell) of the other, and each pair that meets is verified by its cosine in double precision.

Equal vectors are one class: they are linked without being compared. Vectors that are null or zero or hold null or
non-finite components, and vectors of different lengths, link with nothing. Ids may repeat or be null: each row counts
as a vector of its own; the smallest id of a component names it. Other columns may have any name. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.llm.common import U64, components, mix, store

TABLES = 10
PROBES = 16
#: Of the projected unit vectors; a finer lattice has smaller cells.
SCALE = 1.4
COSINE = 0.95
SEED = 97


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs)
    return np.array(out)


NEIGHBOURS = _neighbours()


def nearest(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row: the better of D8 and D8 + 1/2."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        e = y[odd] - r[odd]
        k = np.abs(e).argmax(1)
        rows = np.arange(len(odd))
        r[odd, k] += np.where(e[rows, k] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, probes: int = PROBES, scale: float = SCALE, tables: int = TABLES) -> np.ndarray:
    """Cell numbers by vector, table and probe; the first probe is the own cell. Twice a point's coordinates are
    whole numbers, which are hashed with the table's number."""
    n, d = unit.shape
    weights = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(8)], U64)
    out = np.empty((n, tables, probes + 1), np.int64)
    for t in range(tables):
        x = unit @ np.random.default_rng([SEED, t, d]).standard_normal((d, 8)) * scale
        home = nearest(x)
        gain = (x - home) @ NEIGHBOURS.T
        some = np.argpartition(-gain, min(probes, 239), axis=1)[:, :probes] if probes else np.empty((n, 0), int)
        points = np.concatenate([home[:, None], home[:, None] + NEIGHBOURS[some]], axis=1)
        whole = np.rint(points * 2).astype(np.int64).astype(U64)
        out[:, t] = mix((whole * weights).sum(2, dtype=U64) ^ U64((d << 16) + t)).astype(np.int64)
    return out


def _scaled(column: pa.Array) -> np.ndarray:
    """Rows of a list column (they have one length) as doubles, each by the power of two that brings its largest component
    between 1/2 and 1: exact, and squares neither overflow nor vanish."""
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column(1)])
        for d in np.unique(sizes):
            own = batch.filter(pa.array(sizes == d))
            for k in range(0, own.num_rows, 2048):
                part = own.slice(k, 2048)
                found = cells((x := _scaled(part.column(1))) / _norms(x)[:, None])
                n, t, p = found.shape
                ids = part.column(0).take(pa.array(np.repeat(np.arange(n), t * p)))
                home = np.tile(np.arange(p) == 0, n * t)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.ravel()), pa.array(home)], names=["cls", "cell", "home"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.array([len(a) == len(b) for a, b in zip(batch.column(2), batch.column(3), strict=True)])
        batch = batch.filter(pa.array(same))
        sizes = np.array([len(v) for v in batch.column(2)])
        for d in np.unique(sizes):
            own = batch.filter(pa.array(sizes == d))
            x, y = _scaled(own.column(2)), _scaled(own.column(3))
            cosine = (x * y).sum(1) / (_norms(x) * _norms(y))
            kept = own.filter(pa.array(cosine >= COSINE))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (smallest key reachable by links, itself included),
    kept (key = component_id); one row per vector."""
    v = F.col(embedding).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    # classes of equal vectors, named by a 128-bit digest
    code = F.unhex(F.md5(F.to_json(F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).cast("binary")))
    rows = store(vectors.select(F.col(key).alias("id"), F.when(fine, code).alias("cls"), F.when(fine, v).alias("v")))
    good = rows.where("cls IS NOT NULL")
    classes = store(good.groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    one = store(good.groupBy("cls").agg(F.first("v").alias("v")))
    index = store(one.mapInArrow(_index, "cls binary, cell long, home boolean"))
    pairs = (
        index.where("home").select("cell", F.col("cls").alias("x"))
        .join(index.select("cell", F.col("cls").alias("y")), "cell")
        .where("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    pairs = store(pairs)
    left, right = one.select(F.col("cls").alias("a"), F.col("v").alias("va")), one.select(F.col("cls").alias("b"), F.col("v").alias("vb"))
    links = store(pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(_verify, "a binary, b binary"))
    size = classes.select(F.col("cls").alias("b"), "n")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size, "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    group = store(components(links).join(classes, F.col("node") == F.col("cls")).select("cls", "component", "least"))
    least = group.groupBy("component").agg(F.min("least").alias("component_least"))
    named = group.join(least, "component").select("cls", "component_least")
    facts = store(
        classes.join(degree, "cls", "left").join(named, "cls", "left")
        .select(F.col("cls").alias("c"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_least", "least").alias("least"))
    )
    out = rows.select("id", "cls").join(facts, F.col("cls") == F.col("c"), "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
