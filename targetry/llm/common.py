"""What several operators share: broadcasts, Arrow batches, texts as numpy arrays, lookups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from targetry.operators.components import components
from targetry.sources.tables import forget, store

__all__ = ["components", "forget", "store"]

U64 = np.uint64
#: Texts are handled in blocks of about this many bytes, so that memory doesn't depend on the Arrow batch.
BLOCK_BYTES = 1 << 19
#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1000
#: ASCII white space, which ends a token: \x20 and \x09-\x0D.
SPACE_CODES = (9, 10, 11, 12, 13, 32)
TOKEN_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_PATTERN_LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The multiplier of the polynomial (2**64 over the golden ratio) and, below, those of splitmix64's finalizer.
_MULT = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- intermediate tables -----------------------------------------------------


@contextmanager
def broadcast(spark: SparkSession, value: object) -> Iterator[Broadcast]:
    """value on all executors until the block ends; what reads it has to be stored by then."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from here on: whole texts pass through Python workers, whose memory and that
    of the JVM's buffers grows with the batch. A smaller setting of the user's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


# --- texts as arrays ---------------------------------------------------------


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(at: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; a longer document is a block of its own."""
    n, i = len(at) - 1, 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower_lut() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def space_lut() -> np.ndarray:
    """True for bytes of a white-space token."""
    lut = np.ones(256, bool)
    lut[list(SPACE_CODES)] = False
    return lut


def word_lut() -> np.ndarray:
    """True for bytes of an alphanumeric word in lower-cased text (ASCII letters and digits, all of non-ASCII)."""
    lut = np.zeros(256, bool)
    lut[48:58] = lut[97:123] = True
    lut[128:] = True
    return lut


LOWER, TOKEN_BYTES, WORD_BYTES = lower_lut(), space_lut(), word_lut()


def cut_words(raw: np.ndarray, at: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of the first word of each document (one more at the end)."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = lut[raw]
    edges = at[(at > 0) & (at < len(raw))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        both = []
        for m in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.full(size, m, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 8 * BLOCK_BYTES:  # not kept: one document's length shouldn't stay in memory
            return tuple(both)
        _powers[:] = both
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from prefix sums of a polynomial."""
    if not len(starts):
        return np.empty(0, U64)
    up, down = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of width words inside a document, and where each begins (number of a word)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    h = np.zeros(n, U64)
    for k in range(width):
        h += words[k : k + n] * U64(pow(_MULT, 2 * k + 3, 1 << 64))
    good = np.zeros(len(words) + 1, bool)
    long = (first[1:] - first[:-1]) >= width
    np.add.at(marks := np.zeros(len(words) + 1, np.int32), first[:-1][long], 1)
    np.add.at(marks, first[1:][long] - width + 1, -1)
    good = np.cumsum(marks) > 0
    where = np.flatnonzero(good[:n])
    return mix(h[where] ^ U64(width * 0x9E3779B1)), where


# --- lookups ------------------------------------------------------------------


class Lookup:
    """Index of each of many 64-bit keys in a fixed array of distinct keys, -1 if it isn't there. Vectorised chaining."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(U64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        slot = self._slot(keys)
        self.order = np.argsort(slot, kind="stable")
        self.keys = np.append(keys[self.order], U64(0))
        self.starts = np.searchsorted(slot[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.order = np.append(self.order, 0).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max(initial=0))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        pos, end = self.starts[slot], self.starts[slot + 1]
        hit = (pos < end) & (self.keys[pos] == keys)
        out = np.where(hit, self.order[pos], -1)
        todo = np.flatnonzero(~hit & (pos + 1 < end))
        for k in range(1, self.deepest):
            if not len(todo):
                break
            p = pos[todo] + k
            hit = self.keys[p] == keys[todo]
            out[todo[hit]] = self.order[p[hit]]
            todo = todo[~hit & (p + 1 < end[todo])]
        return out


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their counts (1 each if none are given)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
