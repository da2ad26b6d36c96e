"""The trie of conversations' common prefixes, by a Cartesian tree over their sorted order.

Each distinct sequence of turns is sorted once, with the number of conversations that have it; neighbours' common prefixes
are the values of an array whose Cartesian tree, with equal values merged, is the trie without its unary nodes. Blocks of
the array are worked on in parallel: all nearest smaller values of a block close the nodes that lie within it, and what
stays open, no more than the block's falling minima from either end, is handed on as a short block. Blocks of the next
level are made of these, until one is left. A closed node is expanded into the depths between it and its parent; its
interval's sums are those of its items. A child that was closed before its parent takes the parent's name by a join.

Odd cases. Rows without conversation id don't count. A null role or text is empty. Turns are ordered by number, null first,
then role, then digest; repeated rows are turns each. Turns are told apart by the first 128 bits of SHA-256, prefixes by
those of their turns. Very long conversations: 40 bytes a turn have to fit a row; texts aren't gathered. An empty table gives
an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.llm.common import forget, lean, store
from targetry.llm.smaller import next_smaller, previous_smaller

#: A block has at most so many sequences and turns, but for one longer sequence.
BLOCK_SEQUENCES, BLOCK_TURNS = 8192, 1 << 17
#: Blocks that become one of the next level.
FAN_IN = 64
#: Ids that are joined into one string at once: those that agree but for so many last bits.
ID_BITS = 10
WIDTH = 16
NOBODY = hashlib.sha256(b"").digest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, below binary, name binary"
OPEN = "values binary, counts binary, shared binary, refs binary, names binary, items binary, first binary, cum_left binary, cum_right binary"


def sequences(conversations: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, array<struct<code, size>>: the digest of role and text, and the text's UTF-8 bytes."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    code = F.substring(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256), 1, 2 * WIDTH)
    turn = F.struct(F.col(order).alias("turn"), by.alias("role"), code.alias("code"), F.octet_length(said).cast("long").alias("size"))
    all_ = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return all_.select("conv_id", F.transform("turns", lambda t: F.struct(t["code"].alias("code"), t["size"].alias("size"))).alias("turns"))


# --- distinct sequences in order ------------------------------------------------


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence of the pieces (seq, n, least, ids, path, sizes), which come in order."""
    held, digest = None, None

    def row() -> tuple:
        return (held["path"], held["sizes"], held["n"], held["least"], digest.digest())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["path", "sizes", "n", "least", "ends"])

    for batch in batches:
        rows = []
        for piece in batch.to_pylist():
            if held and held["seq"] == piece["seq"]:
                held["n"] += piece["n"]
                held["least"] = min(held["least"], piece["least"])
                digest.update(b"," + piece["ids"].encode())
                continue
            if held:
                rows.append(row())
            held, digest = piece, hashlib.sha256(piece["ids"].encode())
        if rows:
            yield out(rows)
    if held:
        yield out([row()])


def distinct(seqs: DataFrame) -> DataFrame:
    """path (digests of the turns one after another), sizes, n and least of conv_id, and ends, the SHA-256 of all ids joined
    by commas; one row for each distinct sequence. Ids are joined in pieces, which pass in order through a running digest."""
    rows = seqs.select("conv_id", F.unhex(F.array_join("turns.code", "")).alias("path"), F.col("turns.size").alias("sizes"))
    rows = rows.withColumn("seq", F.unhex(F.sha2("path", 256)))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = rows.groupBy("seq", F.shiftright("conv_id", ID_BITS).alias("piece")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"), F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes")
    )
    return pieces.repartition("seq").sortWithinPartitions("seq", "piece").drop("piece").mapInArrow(_folded, "path binary, sizes array<long>, n long, least long, ends binary")


def _joint(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginning."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(p, np.uint64, 2 * n).reshape(n, 2) for p in (a, b))
    differ = (x != y).any(1)
    return int(differ.argmax()) if differ.any() else n


def _common(paths: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Turns each path has in common with the one before; the first has 0."""
    codes = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    begin = np.append(0, np.cumsum(sizes))[:-1]
    most = np.append(0, np.minimum(sizes[1:], sizes[:-1]))
    seg = np.repeat(np.arange(len(sizes)), most)
    at = np.arange(len(seg)) - np.repeat(np.append(0, np.cumsum(most))[:-1], most)
    differ = np.flatnonzero((codes[begin[seg] + at] != codes[begin[seg - 1] + at]).any(1))
    out = most.copy()
    which, first = np.unique(seg[differ], return_index=True)
    out[which] = at[differ[first]]
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sequences that come in order; numbers as int64."""
    part, no, held, turns = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal no, held, turns
        lengths = np.array([len(r["sizes"]) for r in held])
        paths = [r["path"] for r in held]
        cum = np.concatenate([np.append(0, np.cumsum(np.array(r["sizes"], np.int64))) for r in held])
        numbers = np.array([[r["n"] for r in held], [r["least"] for r in held], lengths, _common(paths, lengths)], np.int64)
        cols = [numbers.tobytes(), b"".join(r["ends"] for r in held), cum.tobytes(), paths[0], paths[-1]]
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([no], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], names=["part", "no", "numbers", "ends", "cum", "first", "last"])
        no, held, turns = no + 1, [], 0
        return out

    for batch in batches:
        for row in batch.to_pylist():
            if held and (len(held) >= BLOCK_SEQUENCES or turns + len(row["sizes"]) > BLOCK_TURNS):
                yield flush()
            held.append(row)
            turns += len(row["sizes"])
    if held:
        yield flush()


# --- closing nodes ----------------------------------------------------------------


def _least_of(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low:high]."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        last, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(last[:-half], last[half:]))
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int64)
    for k in np.unique(level):
        on = level == k
        out[on] = np.minimum(table[k][low[on]], table[k][high[on] - (1 << int(k))])
    return out


class Block:
    """n items in order and the n + 1 boundaries around them.

    values: common prefixes at the boundaries; counts: boundaries merged into each; shared: bytes of the prefix; base: where in
    cum the bytes of its first 0, 1, 2 ... turns stand; name(boundary): the prefix's digest. items: rows of conversations,
    least id, leaves, bytes beyond distinct ones, turns of the first sequence; first: that sequence's ends.
    """

    def __init__(self, values, counts, shared, base, cum, name, items, first):
        self.values, self.counts, self.shared, self.base, self.cum, self.name, self.items, self.first = values, counts, shared, base, cum, name, items, first
        self.n = len(values) - 1
        of = np.arange(1, self.n)
        self.low, self.high = np.full(self.n + 1, -1), np.full(self.n + 1, self.n + 1)
        self.low[1:-1], self.high[1:-1] = previous_smaller(values, of), next_smaller(values, of)
        self.closed = (self.low >= 0) & (self.high <= self.n)
        self.sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(items[[0, 2, 3]], axis=1)], axis=1)
        self.between = np.append(0, np.cumsum(shared))
        self.least = np.zeros(self.n + 1, np.int64)
        on = np.flatnonzero(self.closed)
        self.least[on] = _least_of(items[1], self.low[on], self.high[on])

    def nodes(self, named: bool, single: bool) -> pa.Table:
        """Rows of closed nodes, expanded. named: with their prefix's digest; single: also the ends of single items."""
        v = self.values
        first = previous_smaller(v, np.arange(1, self.n), strict=False)
        own = np.flatnonzero(self.closed)
        own = own[first[own - 1] == self.low[own]]  # the leftmost of equal boundaries stands for the node
        low, high, depth, base = self.low[own], self.high[own], v[own], self.base[own]
        # boundaries of a node have its left end and its depth in common
        on = np.flatnonzero(self.closed)
        pair = (self.low + 1) * (v.max() + 2) + v
        kinds, where = np.unique(pair[on], return_inverse=True)
        children = np.bincount(where, weights=self.counts[on], minlength=len(kinds)).astype(np.int64)[np.searchsorted(kinds, pair[own])] + 1
        ends = self.items[4][low] == depth
        children -= ends
        if single:
            k = np.arange(self.n)
            k = k[self.items[4] > np.maximum(v[:-1], v[1:])]
            low, high = np.append(low, k), np.append(high, k + 1)
            depth, base = np.append(depth, self.items[4][k]), np.append(base, self.base[k])
            children, ends = np.append(children, np.zeros(len(k), np.int64)), np.append(ends, np.ones(len(k), bool))
            own = np.append(own, np.full(len(k), -1))
        count, leaves, saved = self.sums[:, high] - self.sums[:, low]
        saved = saved + self.between[high] - self.between[low + 1]
        least = _least_of(self.items[1], low, high)
        above = np.where(v[low] >= v[high], low, high)
        top = v[above]
        # a row for each depth
        times = depth - top
        r = np.repeat(np.arange(len(low)), times)
        d = top[r] + 1 + np.arange(len(r)) - np.repeat(np.append(0, np.cumsum(times))[:-1], times)
        last, begin = d == depth[r], d == top[r] + 1
        known = self.closed[above]
        parent = np.where(begin, self.least[above[r]], least[r])
        waits = begin & ~known[r] & (top[r] >= 0)
        names = {int(p): self.name(int(p)) for p in np.unique(above[r[waits]])}
        none = begin & ((top[r] < 0) | waits)
        numbers = (least[r], d, parent, count[r], np.where(last, children[r], 1), leaves[r], saved[r] - (count[r] - 1) * self.cum[base[r] + np.maximum(d - 1, 0)])
        cols = [pa.array(x, pa.int64(), mask=none if k == 2 else None) for k, x in enumerate(numbers)]
        end = [self.first[x] if e else NOBODY for x, e in zip(low[r], last & ends[r], strict=True)]
        below = [names[int(a)] if w else None for a, w in zip(above[r], waits, strict=True)]
        name = [self.name(int(b)) if e and b >= 0 else None for b, e in zip(own[r], last, strict=True)] if named else [None] * len(r)
        return pa.table([*cols, *(pa.array(x, pa.binary()) for x in (end, below, name))], names=[c.split()[0] for c in NODE.split(", ")])

    def rest(self) -> dict[str, bytes]:
        """What is open, as a short block: of equal boundaries in a row the first and the last."""
        v = self.values
        open_ = np.flatnonzero(~self.closed[1:-1]) + 1
        inner = np.zeros(len(open_), bool)
        inner[1:-1] = (v[open_[1:-1]] == v[open_[:-2]]) & (v[open_[1:-1]] == v[open_[2:]])
        kept = np.concatenate([[0], open_[~inner], [self.n]])
        counts = self.counts.copy()
        group = np.searchsorted(kept, open_[inner])
        np.add.at(counts, kept[group], self.counts[open_[inner]])
        low, high = kept[:-1], kept[1:]
        count, leaves, saved = self.sums[:, high] - self.sums[:, low]
        items = np.array([count, _least_of(self.items[1], low, high), leaves, saved + self.between[high] - self.between[low + 1], self.items[4][low]])
        cut = lambda b: self.cum[self.base[b] : self.base[b] + max(0, v[b]) + 1].tobytes()
        return {
            "values": v[kept].tobytes(), "counts": counts[kept].tobytes(), "shared": self.shared[kept].tobytes(),
            "refs": (self.low[kept] >= 0).astype(np.int64).tobytes(),  # of which end's sequence the prefix is one
            "names": b"".join(self.name(int(b)) for b in kept), "items": items.tobytes(), "first": b"".join(self.first[k] for k in low),
            "cum_left": cut(0), "cum_right": cut(self.n),
        }


def _result(block: Block, at: int, level: int) -> pa.Table:
    nodes = block.nodes(named=level > 0, single=level == 0)
    whole = block.values[0] < 0 and block.values[-1] < 0
    rest = block.rest() if not whole else None
    names = [c.split()[0] for c in OPEN.split(", ")]
    kinds = pa.schema([("at", pa.int64()), *nodes.schema, *((c, pa.binary()) for c in names)])
    nodes = pa.table([pa.nulls(len(nodes), pa.int64()), *nodes.columns, *(pa.nulls(len(nodes), pa.binary()) for _ in names)], schema=kinds)
    if rest is None:
        return nodes
    return pa.concat_tables([nodes, pa.table([pa.array([at], pa.int64()), *(pa.nulls(1, f.type) for f in list(kinds)[1 : 1 + len(NODE.split(", "))]), *(pa.array([rest[c]], pa.binary()) for c in names)], schema=kinds)])


def _prefix(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: WIDTH * max(0, int(depth))]).digest()[:WIDTH]


def _lowest(table: pa.Table) -> pa.Table:
    """Closes the nodes of one block of sequences. before, after: the last path of the block before and the first of the next."""
    row = table.to_pylist()[0]
    weight, least, length, common = np.frombuffer(row["numbers"], np.int64).reshape(4, -1)
    n = len(weight)
    values = np.append(common, -1)
    values[0] = -1 if row["before"] is None else _joint(row["before"], row["first"])
    values[n] = -1 if row["after"] is None else _joint(row["last"], row["after"])
    cum = np.frombuffer(row["cum"], np.int64)
    begin = np.append(0, np.cumsum(length + 1))[:-1]
    base = np.append(begin, begin[-1])  # the boundary behind the last sequence is a prefix of it
    shared = cum[base + np.maximum(values, 0)]
    items = np.array([weight, least, values[1:] < length, (weight - 1) * cum[begin + length], length])
    ends = [row["ends"][32 * k : 32 * k + 32] for k in range(n)]
    name = lambda b: _prefix(row["first"] if block.low[b] < 0 and b < n else row["last"], values[b])
    block = Block(values, np.ones(n + 1, np.int64), shared, base, cum, name, items, ends)
    return _result(block, row["at"], 0)


def _higher(level: int):
    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        read = lambda c: [np.frombuffer(r[c], np.int64) for r in rows]
        # the boundary between two blocks is the second one's
        join = lambda parts: np.concatenate([*(p[:-1] for p in parts), parts[-1][-1:]])
        ends, place = [], 0
        for left, right in zip(read("cum_left"), read("cum_right"), strict=True):
            ends.append(np.array([place, place + len(left)]))
            place += len(left) + len(right)
        base = join([e[ref] for e, ref in zip(ends, ([*r[:-1], 1] for r in read("refs")), strict=True)])
        cum = np.concatenate([x for pair in zip(read("cum_left"), read("cum_right"), strict=True) for x in pair])
        names = join([np.frombuffer(r["names"], "V16") for r in rows])
        items = np.concatenate([x.reshape(5, -1) for x in read("items")], axis=1)
        first = [r["first"][k : k + 32] for r in rows for k in range(0, len(r["first"]), 32)]
        block = Block(join(read("values")), join(read("counts")), join(read("shared")), base, cum, lambda b: names[b].tobytes(), items, first)
        return _result(block, rows[0]["at"] // FAN_IN, level)

    return work


def trie(seqs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns: conv_id (smallest conversation that begins with it), depth,
    parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of its subtree, ends_sha256 (of the ids of conversations
    that end there). conv_id and depth name the node; its last turn is that conversation's. seqs: conv_id, turns, as
    sequences() gives them; one row for each conversation."""
    spark = seqs.sparkSession
    lean(spark)
    blocks = store(distinct(seqs).repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_blocks, "part long, no long, numbers binary, ends binary, cum binary, first binary, last binary"))
    # number the blocks: a sum for each partition
    parts = sorted((r["part"], r["count"]) for r in blocks.groupBy("part").count().collect())
    shift, total = [], 0
    for part, n in parts:
        shift.append((part, total))
        total += n
    made = f"at long, {NODE}, {OPEN}"
    if not total:
        return spark.createDataFrame([], made).select(*_named())
    at = blocks.join(F.broadcast(spark.createDataFrame(shift, "part long, shift long")), "part").withColumn("at", F.col("shift") + F.col("no")).drop("part", "no", "shift")
    before = at.select((F.col("at") + 1).alias("at"), F.col("last").alias("before"))
    after = at.select((F.col("at") - 1).alias("at"), F.col("first").alias("after"))
    now = store(at.join(before, "at", "left").join(after, "at", "left").groupBy("at").applyInArrow(_lowest, made))
    forget(blocks)
    nodes, level = [now], 0
    while total > 1:
        level += 1
        group = now.where("at IS NOT NULL").withColumn("group", F.floor(F.col("at") / FAN_IN))
        now = store(group.groupBy("group").applyInArrow(_higher(level), made).select(*now.columns))
        nodes.append(now)
        total = -(-total // FAN_IN)
    all_ = nodes[0]
    for more in nodes[1:]:
        all_ = all_.union(more)
    all_ = all_.where("depth IS NOT NULL")
    if not level:
        return all_.select(*_named())
    parents = all_.where("name IS NOT NULL").select("name", F.col("conv_id").alias("above"))
    joined = all_.drop("name").join(parents, F.col("below") == F.col("name"), "left")
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*_named())


def _named() -> list:
    return ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256")]
