"""Jaccard join of shingle sets: all pairs with 100 * intersection >= 75 * union, as connected components.

Every link is found by count vectors: shingles are hashed into GROUPS groups, a set is the point of its group counts, and
the overlap of two sets is at most the sum of their coordinate minima. Points are indexed in packed R-trees whose nodes
hold coordinate maxima and the range of sizes; a node or point is passed over if the bound falls short of the overlap that
the sizes ask for, and surviving pairs are verified on the sets themselves.

One R-tree over everything would meet each point with all others of like size, so trees are built in blocks, which are
found without loss:

1. Equal sets are one class (by a 128-bit digest).
2. A linked set shares three quarters of its shingles, so enough of its first ones (in hash order) stand among the first
   of another class. The first shingles are shuffled with the numbers of their classes, and the classes with enough
   shared ones go on with their whole sets. The same is done with whole sets, of which three quarters have to be shared.
   What passes gets as its keys the first of its shared shingles, the rarest first: linked sets have a key in common.
3. Each set is put into the blocks of its KEYS smallest shared shingles, in pieces of CHUNK; a block's tree names the
   nearest points of each, which are verified. This ties most of a group of near copies without all its pairs.
4. The components so far are the upper level of the index: they are cut into leaves of CHUNK sets, each with its
   bounding box. Each key has a tree over the boxes of the components that hold it, to which their sets are put (the
   smaller component asks), then the trees of the leaves whose boxes let them through, where the pairs left are verified.
   So all links between components are found, and pairs within one need no link.

A key that many classes hold is counted ahead in the task and sent once; shingles that are frequent in one task are
broadcast as such, HOT of them at most, and come last among the keys. No bucket is capped and no pair dropped. Links are
decided on 64-bit hashes of the shingles; n_shingles counts these.

Null and empty texts and those of white space alone have an empty set and link with nothing. Fewer words than WIDTH are
one shingle. Long texts are read whole; a task holds one text's set. Repeated rows and equal sets (ties) are one class. Null
ids are passed through; a component is named by its smallest non-null id. Other columns may have any name. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.llm.common import LOWER, TOKEN_BYTES, U64, blocks, broadcast, components, cut_words, flat_text, forget, lean, mix, store, window_hashes, word_hashes

WIDTH = 5
#: Coordinates of a count vector.
GROUPS = 128
#: Blocks that each set is put into before the components are compared.
KEYS = 3
#: Points verified for each point of such a block, the nearest by the bound.
NEAREST = 3
#: Sets in a piece of a block and in a leaf of a component, points in a leaf of a tree, queries that meet a leaf at once.
CHUNK, LEAF, QUERIES = 1024, 16, 4096
#: Frequent shingles that are broadcast, at most (8 bytes each), and how often they have to be counted.
HOT, FREQUENT = 1 << 20, 256
#: Bits of the bitmap of wanted classes, at most; a fuller one only lets more sets through.
MOST_BITS = 27


def shingles(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in blocks(at):
        low, ends = LOWER[raw[at[i] : at[j]]], at[i : j + 1] - at[i]
        starts, stops, first = cut_words(low, ends, TOKEN_BYTES)
        words = word_hashes(low, starts, stops)
        found, where = window_hashes(words, first, WIDTH)
        cut = np.searchsorted(where, first)
        n_words = np.diff(first)
        for d in range(j - i):
            if n_words[d] >= WIDTH:
                yield np.unique(found[cut[d] : cut[d + 1]])
            elif n_words[d]:
                own = words[first[d] : first[d + 1]]
                yield window_hashes(own, np.array([0, len(own)]), len(own))[0]
            else:
                yield np.empty(0, U64)


def digest(s: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    a, b = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), mix(s + U64(0x14057B7EF767814F)).sum(dtype=U64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def packed(s: np.ndarray) -> bytes:
    return s.astype("<u8").tobytes()


def unpacked(buffer) -> np.ndarray:
    return np.frombuffer(buffer, "<u8").astype(U64)


def number(cls: bytes) -> int:
    """The 64-bit number of a class."""
    return int.from_bytes(cls[:8], "little", signed=True)


def needed(n: int) -> int:
    """Shingles of a set of n that a linked set shares at least."""
    return -(-3 * n // 4)


def slack(n: int) -> int:
    """How many shared ones the longer prefix is to show."""
    return max(1, n // 8)


def prefix(n: int, show: int) -> int:
    """Of two linked sets' first shingles, as many as this from each hold show shared ones (or the smaller show)."""
    return min(n, n - needed(n) + show)


def keys_of(s: np.ndarray) -> np.ndarray:
    """48-bit keys of shingles, in another order than their hashes; sets that share a shingle share its key."""
    return mix(s ^ U64(0xA0761D6478BD642F)) >> U64(16)


def points(s: np.ndarray) -> np.ndarray:
    """The count vector."""
    return np.bincount((mix(s ^ U64(0xE7037ED1A0B428DB)) % U64(GROUPS)).astype(np.int64), minlength=GROUPS).astype("<i4")


class Tree:
    """A packed R-tree over count vectors, or over boxes of them with the range of their sizes: leaves of LEAF entries of
    like size, bounded by coordinate maxima."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, most: np.ndarray | None = None):
        self.order = np.lexsort((counts[:, 0], sizes))
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.largest = self.sizes if most is None else most[self.order]
        self.first = np.arange(0, len(sizes), LEAF)
        self.top = np.maximum.reduceat(self.counts, self.first)
        self.least, self.most = np.minimum.reduceat(self.sizes, self.first), np.maximum.reduceat(self.largest, self.first)

    def near(self, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose bound reaches the overlap that 7 * overlap >= 3 * (size + size) asks for, and their bounds."""
        fits = (3 * size <= 4 * self.most) & (3 * self.least <= 4 * size)
        nodes = np.flatnonzero(fits)
        nodes = nodes[7 * np.minimum(self.top[nodes], counts).sum(1) >= 3 * (size + self.least[nodes])]
        if not len(nodes):
            return nodes, nodes
        at = (self.first[nodes][:, None] + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        own, bound = self.sizes[at], np.minimum(self.counts[at], counts).sum(1)
        good = (3 * size <= 4 * self.largest[at]) & (3 * own <= 4 * size) & (7 * bound >= 3 * (size + own))
        return self.order[at[good]], bound[good]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= 75 * (len(both) - same)


# --- what runs in the tasks ---


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows grouped by their first width columns, by which they are sorted: (key, rows of the other columns)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield from zip(*[c.to_pylist() for c in batch.slice(k, 256).columns], strict=True)

    for key, group in itertools.groupby(rows(), lambda r: r[:width]):
        yield key, (r[width:] for r in group)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls = [], []
        for s in shingles(*flat_text(batch.column(1))):
            n.append(len(s))
            cls.append(digest(s) if len(s) else None)
        num = [c and number(c) for c in cls]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(num, pa.int64())], names=["id", "n", "cls", "num"])


class _Once:
    """Whether a class comes for the first time, as far as a bounded memory tells."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def __call__(self, cls: bytes) -> bool:
        if cls in self.seen:
            return False
        if len(self.seen) > 100_000:
            self.seen.clear()
        self.seen.add(cls)
        return True


def _mark(cls: bytes, key: str | None) -> int:
    return int.from_bytes(hashlib.md5(cls + (key or "").encode()).digest()[:7], "big")


def _on(bitmap: np.ndarray, k: int) -> bool:
    k &= len(bitmap) * 8 - 1
    return bool(bitmap[k >> 3] >> (k & 7) & 1)


def _wanted(bitmap):
    """Of (text, id as text) the sets of wanted classes, each from the document with the class's smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            rows = []
            for s, i in zip(shingles(*flat_text(batch.column(0))), batch.column(1).to_pylist(), strict=True):
                if len(s):
                    c = digest(s)
                    if _on(bitmap.value, _mark(c, i)) and once(c):
                        rows.append((c, number(c), len(s), packed(s)))
            yield _batch(rows, ["cls", "num", "n", "s"], [pa.binary(), pa.int64(), pa.int64(), pa.binary()])

    return run


_ENTRY = np.dtype([("low", "<u4"), ("high", "u1"), ("num", "<i8")])  # the last 40 bits of the key; the class
_HITS = np.dtype([("num", "<i8"), ("hits", "<i4")])
_KEYED = np.dtype([("low", "<u4"), ("high", "<u2"), ("weight", "u1")])
_FLUSH = 1 << 20


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Of texts the number of each class and the keys of its longer prefix."""
    once = _Once()
    for batch in batches:
        for s in shingles(*flat_text(batch.column(0))):
            if len(s) and once(c := digest(s)):
                yield number(c), keys_of(s[: prefix(len(s), slack(len(s)))])


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for num, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield num, keys_of(unpacked(s.as_buffer()))


def _flushed(sets: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (key, class) of about _FLUSH entries at a time, sorted."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for num, keys in sets:
        held.append((keys, np.full(len(keys), num, np.int64)))
        size += len(keys)
        if size > _FLUSH:
            yield _distinct(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _distinct(*map(np.concatenate, zip(*held, strict=True)))


def _distinct(keys: np.ndarray, nums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((nums, keys))
    keys, nums = keys[order], nums[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nums[1:] != nums[:-1])
    return keys[new], nums[new]


def _sizes(keys: np.ndarray) -> np.ndarray:
    """How often each of sorted keys occurs, at each of its places."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return np.repeat(n := np.diff(np.append(first, len(keys))), n)


def _by_part(keys: np.ndarray, bits: int, entries: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """(part, kind, packed entries) for sorted keys of 48 bits, whose first bits are the part."""
    cut = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=U64) << U64(48 - bits))
    return [(p, kind, entries[cut[p] : cut[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(cut)).tolist()]


_PART = (["part", "kind", "e"], [pa.int32(), pa.int32(), pa.binary()])


def _entry(keys: np.ndarray, nums: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), _ENTRY)
    out["low"], out["high"], out["num"] = keys & U64(0xFFFFFFFF), keys >> U64(32) & U64(0xFF), nums
    return out


def _send_firsts(bits: int):
    """Rows (part, kind, e): of kind 0 the entries of keys, of kind 1 how many keys of a class are shared already here. A
    key of several classes here goes on as one entry of class 0 (no class, or one in 2**64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nums in _flushed(_firsts(batches)):
            n = _sizes(keys)
            told, hits = np.unique(nums[n > 1], return_counts=True)
            place = mix(told.view(U64)) >> U64(16)
            order = np.argsort(place)
            own = np.empty(len(told), _HITS)
            own["num"], own["hits"] = told[order], hits[order]
            first = np.append(True, keys[1:] != keys[:-1])
            sent = _entry(keys[first], np.where(n > 1, 0, nums)[first])
            yield _batch(_by_part(keys[first], bits, sent, 0) + _by_part(place[order], bits, own, 1), *_PART)

    return run


def _count_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (num, hits): classes and how many of their keys are shared. Classes told at once in their task count twice if
    they come in several tasks, which only lets more of them pass."""
    for _, rows in _runs(batches, 1):
        entries, told = [], []
        for kind, e in rows:
            (told if kind else entries).append(np.frombuffer(e, _HITS if kind else _ENTRY))
        found, hits = [t["num"] for t in told], [t["hits"] for t in told]
        if entries:
            all_ = np.concatenate(entries)
            keys, nums = _distinct(all_["low"].astype(U64) | all_["high"].astype(U64) << U64(32), all_["num"])
            first = np.append(True, keys[1:] != keys[:-1])
            several = np.logical_or.reduceat((_sizes(keys) > 1) | (nums == 0), np.flatnonzero(first))[np.cumsum(first) - 1]
            got = nums[several & (nums != 0)]
            found.append(got)
            hits.append(np.ones(len(got), np.int32))
        num, at = np.unique(np.concatenate(found), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(num, pa.int64()), pa.array(np.bincount(at, np.concatenate(hits), len(num)).astype(np.int64))], names=["num", "hits"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, n): keys of several classes among those of one flush."""
    for keys, _ in _flushed(_wholes(batches)):
        k, n = np.unique(keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["k", "n"])


def _is_hot(hot: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hot, keys)
    return hot[np.minimum(at, len(hot) - 1)] == keys if len(hot) else np.zeros(len(keys), bool)


def _send_wholes(hot, bits: int):
    """Rows (part, 0, e): entries of the keys that aren't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nums in _flushed(_wholes(batches)):
            cold = ~_is_hot(hot.value[0], keys)
            yield _batch(_by_part(keys[cold], bits, _entry(keys[cold], nums[cold]), 0), *_PART)

    return run


def _return_shared(bits: int):
    """Rows (num, e): the shared keys of a class in one part, with a weight that grows with the number of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _runs(batches, 1):
            all_ = np.concatenate([np.frombuffer(e, _ENTRY) for _, e in rows])
            high = U64(part) << U64(48 - bits)
            keys, nums = _distinct(all_["low"].astype(U64) | all_["high"].astype(U64) << U64(32), all_["num"])
            n = _sizes(keys)
            keys, nums, n = high | keys[n > 1], nums[n > 1], n[n > 1]
            order = np.argsort(nums, kind="stable")
            keys, nums, n = keys[order], nums[order], n[order]
            out = np.empty(len(keys), _KEYED)
            out["low"], out["high"], out["weight"] = keys & U64(0xFFFFFFFF), keys >> U64(32), np.log2(n)
            cut = np.flatnonzero(np.append(True, nums[1:] != nums[:-1])) if len(nums) else np.empty(0, np.int64)
            for k in range(0, len(cut), 4096):
                mine = cut[k : k + 4097].tolist()
                if len(cut) - k <= 4096:
                    mine.append(len(nums))
                yield _batch([(int(nums[a]), out[a:b].tobytes()) for a, b in zip(mine, mine[1:], strict=False)], ["num", "e"], [pa.int64(), pa.binary()])

    return run


def _finalists(hot):
    """Of (cls, n, s, list of e) the sets with three quarters of shared shingles: their smallest shared keys, their keys in
    the order of weight, and their points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_weights = hot.value
        for batch in batches:
            rows = []
            for c, p, e in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                s = unpacked(p.as_buffer())
                keys = keys_of(s)
                back = np.concatenate([np.frombuffer(x.as_buffer(), _KEYED) for x in e.values] if e.is_valid and len(e) else [np.empty(0, _KEYED)])
                known = back["low"].astype(U64) | back["high"].astype(U64) << U64(32)
                order = np.argsort(known)
                known, weight = known[order], back["weight"][order]
                cold, warm = _is_hot(known, keys), _is_hot(hot_keys, keys)
                on = cold | warm
                alone = len(s) - int(on.sum())
                if len(s) - alone >= needed(len(s)):
                    rank = np.zeros(len(s), np.int64)
                    rank[cold] = weight[np.searchsorted(known, keys[cold])]
                    rank[warm] = 64 + hot_weights[np.searchsorted(hot_keys, keys[warm])]
                    shared, rank = keys[on], rank[on]
                    first = shared[np.lexsort((shared, rank))][: prefix(len(s), 1) - alone]
                    rows.append((c.as_py(), len(s), np.sort(shared)[:KEYS].astype(np.int64), np.unique(first).astype(np.int64), points(s).tobytes(), p.as_py()))
            longs = pa.list_(pa.int64())
            yield _batch(rows, ["cls", "n", "least", "keys", "counts", "s"], [pa.binary(), pa.int64(), longs, longs, pa.binary(), pa.binary()])

    return run


def _point(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, "<i4")


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, cls, n, counts, s) sorted by k. In pieces of a block: each point with the nearest that the tree names, if
    the sets are linked and not tied to each other yet."""
    for _, rows in _runs(batches, 1):
        while len(piece := list(itertools.islice(rows, CHUNK))):
            sets = [unpacked(r[3]) for r in piece]
            counts, sizes = np.stack([_point(r[2]) for r in piece]), np.array([r[1] for r in piece])
            tree, root, found = Tree(counts, sizes), np.arange(len(piece)), []
            for i in range(len(piece)) if len(piece) > 1 else ():
                near, bound = tree.near(counts[i], int(sizes[i]))
                left = root[near] != root[i]
                near, bound = near[left], bound[left]
                for j in near[np.argsort(-bound / (sizes[near] + sizes[i]), kind="stable")][:NEAREST].tolist():
                    if root[j] != root[i] and piece[i][0] != piece[j][0] and linked(sets[i], sets[j]):
                        found.append((piece[i][0], piece[j][0]))
                        root[root == root[j]] = root[i]
            if found:
                yield _batch(found, ["a", "b"], [pa.binary()] * 2)


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, leaf, n, counts) sorted by comp and leaf: each leaf's sizes and coordinate maxima."""
    out = []
    for (comp, leaf), rows in _runs(batches, 2):
        least = most = top = None
        for n, counts in rows:
            p = _point(counts)
            least, most, top = (n, n, p) if top is None else (min(n, least), max(n, most), np.maximum(p, top))
        out.append((comp, leaf, least, most, top.tobytes()))
        if len(out) >= 512:
            yield _batch(out, *_BOX)
            out = []
    yield _batch(out, *_BOX)


_BOX = (["comp", "leaf", "least", "most", "top"], [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, box_no, set_no, cls, comp, m, leaf, n, most, counts), sorted; boxes first (cls null), then sets. A tree over
    the boxes with key k names those that let a set through: (cls, comp, leaf). Smaller components ask larger ones."""
    for _, rows in _runs(batches, 3):
        boxes, tree, out = [], None, []
        for cls, comp, m, leaf, n, most, counts in rows:
            if cls is None:
                boxes.append(((m, comp), leaf, n, most, _point(counts)))
            elif boxes:
                tree = tree or Tree(np.stack([b[4] for b in boxes]), np.array([b[2] for b in boxes]), np.array([b[3] for b in boxes]))
                out += [(cls, boxes[j][0][1], boxes[j][1]) for j in tree.near(_point(counts), n)[0].tolist() if boxes[j][0] > (m, comp)]
            if len(out) >= 4096:
                yield _batch(out, *_ASK)
                out = []
        if out:
            yield _batch(out, *_ASK)


_ASK = (["cls", "comp", "leaf"], [pa.binary(), pa.binary(), pa.int64()])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, leaf, salt, own, n, counts, s), sorted, the leaf's own sets first (own null), then the queries with
    their component: pairs of components with a link. The tree is held, queries pass by."""
    for (comp, _, _), rows in _runs(batches, 3):
        held, tree, found = [], None, set()
        for own, n, counts, s in rows:
            if own is None:
                held.append((n, _point(counts), unpacked(s)))
            elif own not in found and held:
                tree = tree or Tree(np.stack([h[1] for h in held]), np.array([h[0] for h in held]))
                mine, (near, bound) = unpacked(s), tree.near(_point(counts), n)
                if any(linked(mine, held[j][2]) for j in near[np.argsort(-bound, kind="stable")].tolist()):
                    found.add(own)
        if found:
            yield _batch([(comp, f) for f in sorted(found)], ["a", "b"], [pa.binary()] * 2)


# --- the plan ---


def _bitmap(marks: DataFrame, n: int) -> np.ndarray:
    """A bitmap of (cls, key as text), bounded by 2**MOST_BITS bits."""
    bits = min(MOST_BITS, max(12, (n * 16).bit_length()))
    mark = F.concat("cls", F.coalesce("key", F.lit("")).cast("binary"))
    k = F.conv(F.substring(F.md5(mark), 1, 14), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(31).cast("int"))
    words = marks.select(F.shiftright(k, 5).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), "<u4")
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype("<u4")
    return out.view(np.uint8)


def _parts(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _dealt(rows: DataFrame, *by: str, then: tuple[str, ...] = ()) -> DataFrame:
    return rows.repartition(_parts(rows.sparkSession), *by).sortWithinPartitions(*by, *then)


def _candidates(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, num, n, s of the classes whose first shingles are shared often enough (stored). texts: text, id as text."""
    spark = texts.sparkSession
    bits = max(8, min(16, (2 * _parts(spark)).bit_length()))
    hits = _dealt(texts.mapInArrow(_send_firsts(bits), "part int, kind int, e binary"), "part").mapInArrow(_count_firsts, "num long, hits long")
    least = F.least(F.greatest(F.lit(1), F.floor(F.col("n") / 8)), F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * 0.75) / 8)))
    asked = store(hits.groupBy("num").agg(F.sum("hits").alias("hits")).join(classes, "num").where(F.col("hits") >= least).select("cls", F.col("least").cast("string").alias("key")))
    with broadcast(spark, _bitmap(asked, asked.count())) as bitmap:
        out = store(texts.mapInArrow(_wanted(bitmap), "cls binary, num long, n long, s binary").dropDuplicates(["cls"]))
    forget(asked)
    return out


def _keyed(sets: DataFrame) -> DataFrame:
    """cls, n, least, keys, counts, s of the sets of which enough is shared (stored)."""
    spark = sets.sparkSession
    bits = max(8, min(16, (2 * _parts(spark)).bit_length()))
    whole = sets.select("num", "s")
    hot = whole.mapInArrow(_frequent, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "k").limit(HOT).orderBy("k").toArrow()
    frequent = hot.column("k").to_numpy().astype(U64), np.log2(np.maximum(hot.column("n").to_numpy(), 1)).astype(np.uint8)
    with broadcast(spark, frequent) as shared:
        back = _dealt(whole.mapInArrow(_send_wholes(shared, bits), "part int, kind int, e binary"), "part").mapInArrow(_return_shared(bits), "num long, e binary")
        back = back.groupBy(F.col("num").alias("back_num")).agg(F.collect_list("e").alias("e"))
        joined = sets.join(back, F.col("num") == F.col("back_num"), "left").select("cls", "s", "e")
        return store(joined.mapInArrow(_finalists(shared), "cls binary, n long, least array<long>, keys array<long>, counts binary, s binary"))


def _tied(sets: DataFrame) -> DataFrame:
    """Links within the blocks of the smallest shared keys. Half of the blocks are cut by size, the others at random."""
    mixed = F.xxhash64("k", "cls")
    place = F.when(F.col("k") % 2 == 0, F.col("n") * (1 << 31) + F.pmod(mixed, F.lit(1 << 31))).otherwise(mixed)
    rows = sets.select(F.explode("least").alias("k"), "cls", "n", "counts", "s").withColumn("place", place)
    many = rows.groupBy(F.col("k").alias("many")).count().where("count > 1").select("many")
    rows = rows.join(many, F.col("k") == F.col("many"), "left_semi")
    rows = rows.repartitionByRange(_parts(sets.sparkSession), "k", "place").sortWithinPartitions("k", "place")
    return rows.select("k", "cls", "n", "counts", "s").mapInArrow(_nearest, "a binary, b binary")


def _between(sets: DataFrame, tied: DataFrame) -> DataFrame:
    """Links between the components so far, as pairs of components. tied: node, component."""
    spark = sets.sparkSession
    named = sets.join(tied, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("comp"), "n", "keys", "counts")
    count = named.groupBy(F.col("comp").alias("_comp")).agg(F.count("*").alias("m"))
    leaf = F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / CHUNK)).alias("leaf")
    named = store(named.join(count, F.col("comp") == F.col("_comp")).select("cls", "comp", "m", leaf, "n", "keys", "counts"))
    # boxes and sets of each key that several components hold; what holds the key in its largest component needn't ask
    rows = named.select(F.explode("keys").alias("k"), "cls", "comp", "m", "leaf")
    rank = F.struct("m", "comp")
    mixed = rows.groupBy(F.col("k").alias("mixed")).agg(F.min(rank).alias("x"), F.max(rank).alias("y"), F.count("*").alias("size")).where("x <> y").select("mixed", F.col("y.comp").alias("largest"), "size")
    rows = store(rows.join(mixed, F.col("k") == F.col("mixed")).drop("mixed"))
    boxes = _dealt(named.select("comp", "leaf", "n", "counts"), "comp", "leaf").mapInArrow(_boxes, "comp binary, leaf long, least long, most long, top binary")
    held = rows.select("k", F.col("comp").alias("_comp"), "m", F.col("leaf").alias("_leaf"), "size").distinct()
    pieces = F.ceil(F.col("size") / CHUNK)
    each = F.sequence(F.lit(0).cast("long"), pieces - 1)
    none, far = F.lit(None).cast("binary"), F.lit(None).cast("long")
    held = held.join(boxes, (F.col("_comp") == F.col("comp")) & (F.col("_leaf") == F.col("leaf"))).withColumn("box_no", F.pmod(F.xxhash64("comp", "leaf"), pieces))
    held = held.select("k", "box_no", F.explode(each).alias("set_no"), none.alias("cls"), "comp", "m", "leaf", F.col("least").alias("n"), "most", F.col("top").alias("counts"))
    own = named.select(F.col("cls").alias("_cls"), "n", "counts")
    asks = rows.where("comp <> largest").join(own, F.col("cls") == F.col("_cls")).withColumn("set_no", F.pmod(F.xxhash64("cls"), pieces))
    asks = asks.select("k", F.explode(each).alias("box_no"), "set_no", "cls", "comp", "m", "leaf", "n", far.alias("most"), "counts")
    asks = store(_dealt(held.union(asks), "k", "box_no", "set_no", then=("cls",)).mapInArrow(_meeting, "cls binary, comp binary, leaf long").distinct())
    # the leaves' sets, for each portion of their queries, and the queries
    salts = asks.groupBy(F.col("comp").alias("_comp"), F.col("leaf").alias("_leaf")).agg(F.ceil(F.count("*") / QUERIES).alias("salts"))
    held = sets.select(F.col("cls").alias("_cls"), "s")
    facts = named.select(F.col("cls").alias("_of"), F.col("comp").alias("own"), "n", "counts")
    at = (F.col("comp") == F.col("_comp")) & (F.col("leaf") == F.col("_leaf"))
    inside = named.join(salts, at).join(held, F.col("cls") == F.col("_cls")).select("comp", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), none.alias("own"), "n", "counts", "s")
    salt = F.pmod(F.xxhash64("cls"), F.col("salts"))
    outside = asks.join(salts, at).join(facts, F.col("cls") == F.col("_of")).join(held, F.col("cls") == F.col("_cls")).select("comp", "leaf", salt.alias("salt"), "own", "n", "counts", "s")
    found = store(_dealt(inside.union(outside), "comp", "leaf", "salt", then=("own",)).mapInArrow(_answers, "a binary, b binary").distinct())
    forget(named, rows, asks)
    return found


def _resolve(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(id, n, cls, num) of each document, and of each class with a link (c, id_least and rep of its component): stored."""
    lean(docs.sparkSession)
    id_type = docs.select(F.col(key).alias("id")).schema[0].dataType.simpleString()
    rows = store(docs.select(F.col(key).alias("id"), F.col(text)).mapInArrow(_describe, f"id {id_type}, n long, cls binary, num long"))
    classes = rows.where("cls IS NOT NULL").groupBy("cls", "num").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("docs"))
    classes = store(classes)
    sets = _candidates(docs.select(F.col(text), F.col(key).cast("string")), classes)
    keyed = _keyed(sets)
    forget(sets)
    links = store(_tied(keyed))
    tied = store(components(links))
    more = _between(keyed, tied)
    forget(keyed, links)
    # a component of one class has no row in tied; it may have got links since
    single = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(tied, "node", "left_anti").select("node", F.col("node").alias("component"))
    upper = components(more).select(F.col("node").alias("_node"), F.col("component").alias("_upper"))
    every = tied.union(single).join(upper, F.col("component") == F.col("_node"), "left").select(F.col("node").alias("g"), F.coalesce("_upper", "component").alias("component"))
    # names: of a component's classes that with the smallest id stands for it
    in_group = store(every.join(classes, F.col("g") == F.col("cls")).select("cls", "component", "least"))
    first = in_group.groupBy(F.col("component").alias("_c")).agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "cls")).alias("first"))
    facts = store(in_group.join(first, F.col("component") == F.col("_c")).select(F.col("cls").alias("c"), F.col("first.least").alias("id_least"), F.col("first.cls").alias("rep")))
    whole = classes.join(facts, F.col("cls") == F.col("c"), "left").select(F.col("cls").alias("c"), F.when(F.col("rep").isNull(), F.col("least")).otherwise(F.col("id_least")).alias("id_least"), F.coalesce("rep", "cls").alias("rep"), "docs")
    facts = store(whole)
    forget(classes, more, tied)
    return rows, facts


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links, itself included); one row per document."""
    rows, facts = _resolve(docs, text, key)
    out = rows.join(facts, F.col("cls") == F.col("c"), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("id_least", "id").alias("component_id"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One document of each component, that with the smallest key (one of them, if rows repeat); the columns of docs.

    Documents with an empty set are all kept. Only the documents that have a copy or a link are shuffled: a bitmap names
    their classes (others may pass for such, and are found to be their own keepers).
    """
    rows, facts = _resolve(docs, text, key)
    names, spark = docs.columns, docs.sparkSession
    grouped = facts.groupBy(F.col("rep").alias("_rep")).agg(F.sum("docs").alias("all")).where("all > 1")
    contested = store(facts.join(grouped, F.col("rep") == F.col("_rep"), "left_semi").select("c", "id_least", (F.col("c") == F.col("rep")).alias("is_rep")))
    bitmap = spark.sparkContext.broadcast(_bitmap(contested.select(F.col("c").alias("cls"), F.lit("").alias("key")), contested.count()))
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    k = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [digest(s) if len(s) else None for s in shingles(*flat_text(batch.column(k)))]
            marks = pa.array([c if c is not None and _on(bitmap.value, _mark(c, None)) else None for c in cls], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*batch.schema.names, "mark"])

    marked = inner.mapInArrow(run, inner.select("*", F.lit(None).cast("binary").alias("mark")).schema)
    passed = marked.where("mark IS NULL")
    own = F.col(f"c{names.index(key)}")
    open_ = marked.where("mark IS NOT NULL").join(contested, F.col("mark") == F.col("c"), "left")
    open_ = open_.where(F.col("c").isNull() | (F.col("is_rep") & own.eqNullSafe(F.col("id_least"))))
    # rows that repeat a keeper's text and key: one of them; a class that only passes for contested has one row
    kept = open_.dropDuplicates(["mark", f"c{names.index(key)}"])
    return passed.select(*inner.columns).union(kept.select(*inner.columns)).toDF(*names)
