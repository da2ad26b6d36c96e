"""Language-model scores: prediction by partial matching over bytes, pretrained on the learning documents, and a unigram
word model with add-one smoothing as the base.

The trie holds the byte contexts up to ORDER of all learning documents. A symbol not seen in a context escapes to the
next shorter one (escape estimate C: distinct symbols over distinct symbols plus occurrences), where the symbols of the
longer context are excluded; below the empty context all unseen bytes are alike. Texts are lower-cased (A-Z), begin in a
context of zero bytes and end with one zero byte.

Counts cover all learning documents and grow with them. The most frequent words are broadcast, BROADCAST_WORDS of them;
all others are joined by shuffling. The trie is broadcast in slices of at most SLICE_PAIRS pairs of context and symbol,
dealt by the two latest bytes; each slice scores the positions that belong to it in a pass of its own.

Null texts count as empty: one end token, one end symbol. Without learning documents all counts are 0. Repeated rows count
and are scored each on its own; of equally frequent words those of smaller hashes are broadcast. Long texts are read whole.
An empty table gives an empty result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from targetry.llm.common import LOWER, TOKEN_BYTES, U64, Lookup, blocks, cut_words, flat_text, forget, lean, store, summed, word_hashes

ORDER = 4
BROADCAST_WORDS = 1 << 18
SLICE_PAIRS = 1 << 22
_WORD, _GRAM, _DOCS = 0, 1, 2
_FLUSH = 1 << 20


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the context of ORDER bytes and the byte, as one number; where each text
    begins among them."""
    n, lens = len(at) - 1, np.diff(at)
    shift = np.repeat(np.arange(n) * (ORDER + 1) + ORDER, lens)
    padded = np.zeros(len(raw) + n * (ORDER + 1), np.uint8)
    padded[np.arange(len(raw)) + shift] = LOWER[raw]
    key = np.zeros(max(0, len(padded) - ORDER), U64)
    for k in range(ORDER + 1):
        key <<= U64(8)
        key |= padded[k : k + len(key)]
    good = np.ones(len(key), bool)
    for k in range(n - 1):  # windows that reach into the next text
        end = int(at[k + 1]) + (k + 1) * (ORDER + 1)
        good[end - ORDER : end] = False
    return key[good], at + np.arange(n + 1)


class Trie:
    """Tables of all orders. part: only the contexts that rest are asked for here (others give 0)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray, parts: int, part: int):
        """keys, counts: pairs of the longest order in this slice; low_keys, low_counts: of order 1, over everything."""
        self.parts, self.part = parts, part
        pairs, order = {}, ORDER
        pairs[order] = summed(keys, counts)
        for j in range(ORDER - 1, 1, -1):
            pairs[j] = summed(pairs[j + 1][0] & U64((1 << 8 * (j + 1)) - 1), pairs[j + 1][1])
        pairs[1] = summed(low_keys, low_counts)
        pairs[0] = summed(pairs[1][0] & U64(0xFF), pairs[1][1])
        self.pair, self.num, self.node, self.top, self.down = {}, {}, {}, {}, {}
        totals = {}
        for j in range(ORDER + 1):
            k, c = pairs[j]
            context = k >> U64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(k) else np.empty(0, np.int64)
            n = np.add.reduceat(c, first) if len(first) else np.empty(0, np.int64)
            d = np.diff(np.append(first, len(k)))
            self.pair[j], self.num[j] = Lookup(k), np.log10(c)
            self.node[j] = Lookup(context[first])
            self.top[j] = np.log10(n + d), np.log10(d) - np.log10(n + d)
            totals[j] = n, d
            if j:
                # seen from the parent, once this context's symbols are excluded
                up = self.node[j - 1](context[first] & U64((1 << 8 * (j - 1)) - 1))
                owner = np.repeat(np.arange(len(first)), d)
                at_parent = pairs[j - 1][1][self.pair[j - 1](k & U64((1 << 8 * j) - 1))]
                gone = np.bincount(owner, at_parent, len(first)) if len(first) else np.empty(0)
                n_left, d_left = totals[j - 1][0][up] - gone, totals[j - 1][1][up] - d
                with np.errstate(divide="ignore", invalid="ignore"):
                    whole = np.log10(n_left + d_left)
                    self.down[j] = whole, np.where(d_left > 0, np.log10(d_left) - whole, 0.0)
        self.rest = -np.log10(max(1, 256 - int(totals[0][1][0]) if len(totals[0][1]) else 256))
        context = pairs[ORDER][0] >> U64(8)
        #: The usual case in one step: the pair is known in its longest context.
        self.direct = self.num[ORDER] - self.top[ORDER][0][self.node[ORDER](context)] if len(context) else np.empty(0)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte in its context; 0 where another slice has it."""
        out = np.zeros(len(keys))
        ask = np.arange(len(keys)) if self.parts == 1 else np.flatnonzero(part_of(keys, self.parts) == self.part)
        found = self.pair[ORDER](keys[ask])
        known = found >= 0
        out[ask[known]] = self.direct[found[known]]
        ask = ask[~known]
        if len(ask):
            some, back = np.unique(keys[ask], return_inverse=True)
            out[ask] = self._escape(some)[back]
        return out

    def _escape(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        open_, above = np.arange(len(keys)), np.full(len(keys), -1)  # above: node of the longer context escaped from
        for j in range(ORDER, -1, -1):
            k = keys[open_] & U64((1 << 8 * (j + 1)) - 1)
            node, hit = self.node[j](k >> U64(8)), self.pair[j](k)
            entered = node >= 0
            if j < ORDER:
                via = above[open_] >= 0
                excluded = self.down[j + 1]
            else:
                via, excluded = np.zeros(len(open_), bool), None
            for fresh in (True, False):
                own = entered & (via != fresh)
                if fresh:
                    whole, esc = self.top[j][0][node[own]], self.top[j][1][node[own]]
                elif excluded is not None:
                    whole, esc = excluded[0][above[open_[own]]], excluded[1][above[open_[own]]]
                else:
                    continue
                h = hit[own]
                gain = np.where(h >= 0, self.num[j][np.maximum(h, 0)] - whole, esc) if len(h) else np.empty(0)
                out[open_[own]] += gain
            above[open_] = np.where(entered, node, -1)
            open_ = open_[hit < 0]
        out[open_] += self.rest
        return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Slice by the two bytes before the symbol: all contexts of order 2 and more of a position are in one slice."""
    return (((keys >> U64(8)) & U64(0xFFFF)) * U64(40503) >> U64(4)) % U64(parts)


def _counter(text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = 0, {_WORD: [], _GRAM: []}
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    keys, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    yield rows(kind, keys, counts)
                    parts.clear()

        def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            raw, at = flat_text(batch.column(text))
            docs += batch.num_rows
            for i, j in blocks(at):
                part, ends = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                low = LOWER[part]
                starts, stops, _ = cut_words(low, ends, TOKEN_BYTES)
                for kind, keys in ((_WORD, word_hashes(low, starts, stops)), (_GRAM, grams(part, ends)[0])):
                    if len(keys):
                        held[kind].append(summed(keys))
                        waiting += len(held[kind][-1][0])
                if waiting > _FLUSH:
                    yield from flush()
                    waiting = 0
        yield from flush()
        yield rows(_DOCS, np.zeros(1, np.int64), np.array([docs]))

    return run


def _pairs(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = counts.select("key", "n").toArrow()
    return t.column("key").to_numpy().astype(U64), t.column("n").to_numpy()


def score(docs: DataFrame, learn: Column, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, n_tokens, n_known, train_tokens, base_score, score; one row per document. Columns of carry that
    have one of these names are replaced.

    learn: which documents to learn from (null: not).
    """
    carry = tuple(c for c in carry if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))
    lean(docs.sparkSession)
    counts = store(
        docs.where(F.coalesce(learn, F.lit(False))).select(F.col(text).alias("t")).mapInArrow(_counter(0), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    )
    by_kind = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()}
    n_docs = by_kind[_DOCS].n if _DOCS in by_kind else 0
    n_words, v_words = (by_kind[_WORD].n, by_kind[_WORD].d) if _WORD in by_kind else (0, 0)
    total, distinct = n_words + n_docs, v_words + (1 if n_docs else 0)
    below = float(np.log10(total + distinct + 1))
    words = counts.where(F.col("kind") == _WORD)
    top_keys, top_counts = _pairs(words.orderBy(F.col("n").desc(), "key").limit(BROADCAST_WORDS))
    least = int(top_counts.min()) if len(top_counts) == BROADCAST_WORDS else 0
    n_pairs = by_kind[_GRAM].d if _GRAM in by_kind else 0
    parts = max(1, -(-n_pairs // SLICE_PAIRS))
    pairs = counts.where(F.col("kind") == _GRAM)
    low = _pairs(pairs.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")))
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast((Lookup(top_keys), np.log10(top_counts + 1.0)))
    end = float(np.log10(n_docs + 1.0)), int(n_docs > 0)

    now = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"), F.lit(0.0).alias("_score"))
    for part in range(parts):
        latest = (F.shiftright("key", 8).bitwiseAND(0xFFFF) * 40503)
        own = pairs if parts == 1 else pairs.where(F.shiftright(latest, 4) % parts == part)
        trie = spark.sparkContext.broadcast(Trie(*_pairs(own), *low, parts, part))
        if part < parts - 1:
            before, now = now, store(now.mapInArrow(_scorer(trie, now.columns), now.schema))
            trie.destroy()
            forget(before)
    schema = now.drop("_text").select("*", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), F.array().cast("array<bigint>").alias("rare"), F.array().cast("array<bigint>").alias("rare_n")).schema
    scored = store(now.mapInArrow(_base(vocabulary, trie, end, below, now.columns), schema))
    rare = scored.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("_row", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("m"))
    rare = rare.join(words.where(F.col("n") <= least).select("key", "n") if least else words.where("false").select("key", "n"), "key", "left")
    sums = rare.groupBy("_row").agg(
        F.sum(F.col("m") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.lit(below))).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known"),
    )
    out = scored.join(sums, "_row", "left")
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        F.col("_score").alias("score"),
    )


def _scorer(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            raw, at = flat_text(batch.column(names.index("_text")))
            sums = []
            for i, j in blocks(at):
                keys, first = grams(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                sums.append(np.add.reduceat(trie(keys), first[:-1]))
            k = names.index("_score")
            new = np.concatenate(sums) + batch.column(k).to_numpy() if sums else np.empty(0)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.float64()) if c == k else x for c, x in enumerate(batch.columns)], names=names)

    return run


def _base(shared, shared_trie, end: tuple[float, int], below: float, names: list[str]):
    """The last slice's scores, and of the words what the broadcast ones give."""
    last_slice = _scorer(shared_trie, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        batches = last_slice(batches)
        for batch in batches:
            k = names.index("_text")
            raw, at = flat_text(batch.column(k))
            n_tokens, n_known, base, rare, rare_n = [], [], [], [], []
            for i, j in blocks(at):
                low = LOWER[raw[at[i] : at[j]]]
                starts, stops, first = cut_words(low, at[i : j + 1] - at[i], TOKEN_BYTES)
                hashes = word_hashes(low, starts, stops)
                found = known(hashes)
                hit = found >= 0
                gain = np.append(0.0, np.cumsum(np.where(hit, logs[np.maximum(found, 0)] - below, 0.0) if len(logs) else np.zeros(len(hashes))))
                hits = np.append(0, np.cumsum(hit))
                miss = np.flatnonzero(~hit)
                cut = np.searchsorted(miss, first)
                n_tokens.append(np.diff(first) + 1)
                n_known.append(np.diff(hits[first]) + end[1])
                base.append(np.diff(gain[first]) + end[0] - below)
                for d in range(j - i):
                    keys, counts = np.unique(hashes[miss[cut[d] : cut[d + 1]]], return_counts=True)
                    rare.append(keys.astype(np.int64))
                    rare_n.append(counts)
            flat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0, t), pa.from_numpy_dtype(t))
            new = [flat(n_tokens, np.int64), flat(n_known, np.int64), flat(base, np.float64), pa.array(rare, pa.list_(pa.int64())), pa.array(rare_n, pa.list_(pa.int64()))]
            kept = [c for c in range(len(names)) if c != k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*[names[c] for c in kept], "n_tokens", "n_known", "base", "rare", "rare_n"])

    return run
