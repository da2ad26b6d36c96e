"""Periodic runs of words by a suffix tree: a run is a stretch of words that repeats with a smallest period q at least
twice, and that no neighbouring word continues.

A block's suffixes are sorted by prefix doubling, which gives the tree's inner nodes as intervals of the suffix array with
their depths. For each node the leaves of its smaller half are listed; a leaf i and the leaf i + depth or i - depth in the
other half begin a branching tandem repeat, the last one of a run. Repeats whose root is a power are dropped, and the others
are rotated to the left as far as they go, which merges the repeats of a run.

Odd cases. Null and empty texts have no words. Very long texts are read whole, in a block of their own; memory goes with
n log n words. Words are told apart by 64-bit hashes within their text. Repeated rows are worked on each by itself. Ties
don't arise: runs are ordered by start and period. An empty table gives an empty result. Columns to carry may have any
name; where one is that of a result, give a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from targetry.llm.common import TOKEN_BYTES, U64, blocks, cut_words, flat_text, lean, mix, word_hashes
from targetry.llm.smaller import next_smaller, previous_smaller

#: Words that a run has at least.
LEAST = 12
#: Leaves listed at once.
LISTED = 1 << 20


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the longest common prefix of each with the one before (-1 for the first). Prefix doubling:
    each round sorts only suffixes whose order is still open by the ranks of what follows; the ranks of all rounds give the
    common prefixes. ids: whole numbers from 0 up."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    head = np.ones(n, bool)
    head[1:] = ids[order[1:]] != ids[order[:-1]]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width = [rank], 1
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(open_):
        sub = order[open_]
        key = rank[sub].astype(np.int64) * (n + 1) + rank[np.minimum(sub + width, n)] + 1
        by = np.argsort(key, kind="stable")
        sub, key = sub[by], key[by]
        order[open_] = sub
        first = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[sub] = open_[np.maximum.accumulate(np.where(first, np.arange(len(sub)), 0))]
        levels.append(rank)
        width *= 2
        open_ = open_[~(first & np.append(first[1:], True))]
    common = np.zeros(n, np.int64)
    common[:1] = -1
    at = np.flatnonzero(~head)
    a, b = order[at - 1].copy(), order[at].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero((levels[k][a] == levels[k][b]) & (levels[k][a] >= 0))
        a[same] += 1 << k
        b[same] += 1 << k
    common[at] = b - order[at]
    return order, common


def branching_repeats(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of all tandem repeats whose next word doesn't continue them."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    node = np.flatnonzero(common > 0)
    low, high = previous_smaller(common, node), next_smaller(common, node, strict=False)
    left = node - low <= high - node  # the smaller half
    count = np.where(left, node - low, high - node)
    begin = np.where(left, low, node)
    other = np.where(left, node, low), np.where(left, high, node)
    starts, periods = [], []
    total, k = np.append(0, np.cumsum(count)), 0
    while k < len(node):
        e = max(k + 1, int(np.searchsorted(total, total[k] + LISTED, "right")) - 1)
        which = np.repeat(np.arange(k, e), count[k:e])
        leaf = order[begin[which] + np.arange(len(which)) - (total[which] - total[k])]
        depth = common[node[which]]
        for start, partner in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
            inside = np.flatnonzero((partner >= 0) & (partner < n))
            r = rank[partner[inside]]
            hit = inside[(r >= other[0][which[inside]]) & (r < other[1][which[inside]])]
            starts.append(start[hit])
            periods.append(depth[hit])
        k = e
    return np.concatenate([*starts, np.empty(0, np.int64)]), np.concatenate([*periods, np.empty(0, np.int64)])


def rotated(ids: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Starts moved to the left as long as the words a period apart agree."""
    starts, todo, width = starts.copy(), np.arange(len(starts)), 8
    while len(todo):
        moved = np.empty(len(todo), np.int64)
        step = max(1, LISTED // width)
        for k in range(0, len(todo), step):
            some = todo[k : k + step]
            at = starts[some, None] - 1 - np.arange(width)
            same = (at >= 0) & (ids[np.maximum(at, 0)] == ids[np.maximum(at, 0) + periods[some, None]])
            moved[k : k + step] = np.where(same.all(1), width, same.argmin(1))
        starts[todo] -= moved
        todo, width = todo[moved == width], min(width * 4, LISTED)
    return starts


def maximal(ids: np.ndarray, starts: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs that branching repeats end. Of the repeats that share an end the one of least period
    is rotated first; others whose root is a power of its root lie within its run and go. A position ends few others."""
    end = starts + 2 * periods
    by = np.lexsort((periods, end))
    starts, periods, end = starts[by], periods[by], end[by]
    todo, done, begin = np.arange(len(starts)), [], starts.copy()
    while len(todo):
        first = np.append(True, end[todo[1:]] != end[todo[:-1]])
        settled = todo[first]
        begin[settled] = rotated(ids, starts[settled], periods[settled])
        done.append(settled)
        run = settled[np.cumsum(first) - 1]
        todo = todo[~first & ((periods[todo] % periods[run] != 0) | (starts[todo] < begin[run]))]
    done = np.concatenate([*done, np.empty(0, np.int64)])
    return begin[done], end[done], periods[done]


def runs_of(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least so many words, by start and period."""
    starts, ends, periods = maximal(ids, *branching_repeats(*suffix_array(ids)))
    long = ends - starts >= least
    starts, ends, periods = starts[long], ends[long], periods[long]
    by = np.lexsort((periods, starts))
    return starts[by], (ends - starts)[by], periods[by]


def _block(raw: np.ndarray, at: np.ndarray, least: int) -> list[pa.Array]:
    """n_words, runs and collapsed of the texts of a block."""
    begin, end, first = cut_words(raw, at, TOKEN_BYTES)
    docs, n = len(at) - 1, len(begin)
    doc = np.repeat(np.arange(docs), np.diff(first))
    # a word counts as another one in each text: no repeat reaches beyond its text
    ids = np.unique(mix(word_hashes(raw, begin, end) + doc.astype(U64) * U64(0xD1342543DE82EF95)), return_inverse=True)[1]
    start, length, period = runs_of(ids, least)
    own = doc[start]
    fields = [pa.array(x) for x in (start - first[own], length, period)]
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(docs + 1)), pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.flatnonzero(np.cumsum(change[:n]) == 0)
    # kept words with the byte behind each, made a space; none behind a text's last
    last = np.append(doc[kept[1:]] != doc[kept[:-1]], True)[: len(kept)]
    out, cover = raw.copy(), np.zeros(len(raw) + 1, np.int8)
    until = end[kept] + ~last
    out[end[kept[~last]]] = 32
    cover[begin[kept]] += 1
    cover[until] -= 1  # no two words end at one place
    mask = np.cumsum(cover[:-1], dtype=np.int8) > 0
    size = np.bincount(doc[kept], weights=until - begin[kept], minlength=docs).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(docs, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(out[mask]))
    return [pa.array(np.diff(first)), runs, text.cast(pa.string())]


def find(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), least: int = LEAST, prefix: str = "") -> DataFrame:
    """The carried columns, n_words, runs array<struct<start, length, period>> in words from 0, by start and period, and
    collapsed: the text's words without those that a run repeats after its first period, joined by single spaces."""
    lean(docs.sparkSession)
    kind = T._parse_datatype_string(f"{prefix}n_words long, {prefix}runs array<struct<start:long,length:long,period:long>>, {prefix}collapsed string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = flat_text(batch.column(batch.num_columns - 1))
            for i, j in blocks(at):
                some = batch.slice(i, j - i)
                found = _block(raw[at[i] : at[j]], at[i : j + 1] - at[i], least)
                names = [*batch.schema.names[:-1], *kind.names]
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(batch.num_columns - 1)), *found], names=names)

    one = docs.select(*carry, F.col(text).alias("__text"))
    return one.mapInArrow(work, T.StructType([*one.schema.fields[:-1], *kind.fields]))
