"""Benchmark decontamination: a broadcast set of hashed test n-grams, a scan of all windows of the training texts, a
check of each hit word by word, and the hit spans.

Null texts have no words and are clean. An item of fewer words than the window is one window of all its words; an item
without words matches nothing. Item ids may repeat: they are listed once. Items without an id count like the others: a
text that holds any of them is hit and has one null among its items. Repeated rows are scanned each on its own, and so
are long texts, whole. Empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.llm.common import LOWER, U64, WORD_BYTES, WORD_PATTERN, blocks, cut_words, flat_text, forget, lean, store, window_hashes, word_hashes
from targetry.operators.stats import prefix_sums

WINDOW = 10
#: Bytes of benchmark text in one broadcast set, each word counted as WORD_COST bytes at least. In memory a set takes at
#: most some seven times as much. A larger benchmark is dealt into several sets, each scanned in a pass of its own; the
#: spans of all passes are merged. An item over this bound is cut into pieces that share their windows' words.
SET_BYTES = 16 << 20
WORD_COST = 5


class Layer:
    """Distinct windows of one width, in order of their hashes: where each stands and the items that hold it."""

    def __init__(self, hashes: np.ndarray, where: np.ndarray, items: np.ndarray):
        """One entry for each window and item, ordered by hash, then item."""
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        self.keys, self.where, self.items = hashes[first], where[first], items
        self.at = np.append(first, len(hashes)).astype(np.int32)
        # a small table of bits by the hashes' low bits, which most windows fail
        bits = max(16, int(len(first) * 16).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.sieve = np.zeros(1 << bits - 3, np.uint8)
        low = self.keys & self.mask
        np.bitwise_or.at(self.sieve, low >> U64(3), np.left_shift(1, (low & U64(7)).astype(np.uint8), dtype=np.uint8))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the number of the known window of each."""
        low = hashes & self.mask
        maybe = np.flatnonzero(self.sieve[low >> U64(3)] >> (low & U64(7)).astype(np.uint8) & 1)
        known = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[known] == hashes[maybe]
        return maybe[hit], known[hit]


class Grams:
    """All windows of some items: one buffer of their words, where each word begins, and layers of windows by width. A
    width has more than one layer only where different windows share a hash."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        number: dict[str | None, int] = {}
        data, begins, n_words, n_bytes = [], [], 0, 0
        entries: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, first = cut_words(raw, np.array([0, len(raw)]), WORD_BYTES)
            if not len(starts):
                continue
            width = min(window, len(starts))
            hashes, where = window_hashes(word_hashes(raw, starts, ends), first, width)
            kept = WORD_BYTES[raw]
            kept[ends[ends < len(raw)]] = True
            words = raw[starts[0] :][kept[starts[0] :]]
            begin = np.append(0, np.cumsum(ends - starts + 1)[:-1])
            words[begin[1:] - 1] = 32
            words = np.append(words[: begin[-1] + ends[-1] - starts[-1]], np.uint8(32))
            entries.setdefault(width, []).append((hashes, (where + n_words).astype(np.int32), np.full(len(hashes), number.setdefault(item, len(number)), np.int32)))
            data.append(words)
            begins.append((begin + n_bytes).astype(np.int32))
            n_words, n_bytes = n_words + len(starts), n_bytes + len(words)
        if n_bytes >= 1 << 31:
            raise ValueError("a set of windows holds at most 2 GB of text")
        self.names = list(number)
        self.data = np.concatenate(data).tobytes() if data else b""
        del data
        self.begins = np.append(np.concatenate(begins) if begins else np.empty(0, np.int32), np.int32(n_bytes))
        self.layers: list[tuple[int, Layer]] = []
        for width in sorted(entries):
            hashes, where, own = (np.concatenate(x) for x in zip(*entries.pop(width), strict=True))
            while len(hashes):
                order = np.lexsort((own, hashes))
                hashes, where, own = hashes[order], where[order], own[order]
                other = self._differ(hashes, where, width)
                # of a window that an item holds more than once one entry is enough
                fresh = ~other
                again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1]) & fresh[1:] & fresh[:-1]) + 1
                fresh[again] = False
                self.layers.append((width, Layer(hashes[fresh], where[fresh], own[fresh])))
                hashes, where, own = hashes[other], where[other], own[other]

    def _differ(self, hashes: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
        """Of windows ordered by hash, those that have other words than the first one of their hash."""
        first = np.maximum.accumulate(np.where(np.append(True, hashes[1:] != hashes[:-1]), np.arange(len(hashes)), 0))
        out = np.zeros(len(hashes), bool)
        repeats = np.flatnonzero(first < np.arange(len(hashes)))
        for k in repeats.tolist():
            out[k] = self.window(where[k], width) != self.window(where[first[k]], width)
        return out

    def window(self, word: int, width: int) -> bytes:
        return self.data[self.begins[word] : self.begins[word + width] - 1]

    def nbytes(self) -> int:
        arrays = [x for _, layer in self.layers for x in (layer.keys, layer.where, layer.items, layer.at, layer.sieve)]
        return len(self.data) + sum(x.nbytes for x in [self.begins, *arrays])

    def scan(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str | None]]]:
        """For each text: its number, its number of words, hit spans (first word, end; merged), items."""
        raw = LOWER[raw]
        starts, ends, first = cut_words(raw, at, WORD_BYTES)
        words, data = word_hashes(raw, starts, ends), None
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for width, layer in self.layers:
            hashes, where = window_hashes(words, first, width)
            hits, known = layer.find(hashes)
            places = where[hits]
            docs = np.searchsorted(first, places, "right") - 1
            for w, doc, k in zip(places.tolist(), docs.tolist(), known.tolist(), strict=True):
                data = raw.tobytes() if data is None else data
                if self.window(layer.where[k], width) == b" ".join(data[starts[x] : ends[x]] for x in range(w, w + width)):
                    spans.setdefault(doc, []).append((w - int(first[doc]), w - int(first[doc]) + width))
                    items.setdefault(doc, set()).update(layer.items[layer.at[k] : layer.at[k + 1]].tolist())
        for doc in range(len(at) - 1):
            yield doc, int(first[doc + 1] - first[doc]), merge(spans.get(doc, ())), {self.names[x] for x in items.get(doc, ())}


def merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES, prefix: str = "") -> DataFrame:
    """docs with n_words, spans (array of struct(start, end) in words, merged) and items (array of item ids) added.

    prefix goes before the names of the three; columns of docs that have these names are replaced.
    """
    n_words, spans, held = (f"{prefix}{c}" for c in ("n_words", "spans", "items"))
    docs = docs.drop(n_words, spans, held)
    out = _scanned(docs, items, text, item_id, item_text, window, set_bytes, None)
    pair = F.transform(F.sequence(F.lit(0), (F.size("__spans") / 2 - 1).cast("int")), lambda i: F.struct(F.col("__spans")[i * 2].alias("start"), F.col("__spans")[i * 2 + 1].alias("end")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(*docs.columns, F.col("__n").alias(n_words), F.when(F.size("__spans") > 0, pair).otherwise(empty).alias(spans), F.col("__items").alias(held))


def _scanned(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, set_bytes: int, most_hit: float | None) -> DataFrame:
    """docs with __n, __spans (flat) and __items. With most_hit: docs without hit spans and without the texts that are hit
    by more, cut in the last pass. A benchmark of several sets takes a pass for each, stored in between, so that no task
    holds two sets."""
    spark = docs.sparkSession
    lean(spark)
    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
    cost = F.coalesce(F.greatest(F.octet_length("text"), WORD_COST * F.regexp_count("text", F.lit(WORD_PATTERN))), F.lit(0))
    passes = 1
    if (named.agg(F.sum(cost)).first()[0] or 0) > set_bytes:
        named = _dealt(named.distinct().withColumn("cost", cost.cast("long")), window, set_bytes)
        passes = (named.agg(F.max("set")).first()[0] or 0) + 1
    k = docs.columns.index(text)
    schema = docs.select("*", F.lit(0).cast("long").alias("__n"), F.lit(None).cast("array<bigint>").alias("__spans"), F.lit(None).cast("array<string>").alias("__items")).schema
    out = docs
    for i in range(passes):
        part = named.where(F.col("set") == i) if passes > 1 else named
        shared = spark.sparkContext.broadcast(Grams(((r.item, r.text) for r in part.select("item", "text").toLocalIterator()), window))
        last = i == passes - 1
        before, out = out, out.mapInArrow(_scanner(shared, k, i > 0, most_hit if last else None), docs.schema if last and most_hit is not None else schema)
        if not last:
            out = store(out)
            shared.destroy()
            forget(before)
    return out


def _dealt(named: DataFrame, window: int, set_bytes: int) -> DataFrame:
    """item, text, set: items dealt into sets of about set_bytes by running sums of their cost, those of more than that
    in pieces of about half of it."""
    words = F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), F.lit(1))
    large = named.where(F.col("cost") > set_bytes).withColumn("words", words)
    step = F.greatest(F.lit(window), F.floor(F.size("words") * (set_bytes / 2) / F.col("cost")).cast("int"))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), step)
    large = large.withColumn("step", step).select("item", "words", "step", F.explode(cuts).alias("piece"))
    large = large.select("item", F.array_join(F.slice("words", F.col("piece") + 1, F.col("step") + (window - 1)), " ").alias("text"), "piece")
    large = large.withColumn("cost", F.greatest(F.octet_length("text"), WORD_COST * F.regexp_count("text", F.lit(WORD_PATTERN))).cast("long"))
    rows = named.where(F.col("cost") <= set_bytes).select("item", "text", F.lit(0).alias("piece"), "cost").unionByName(large)
    return store(prefix_sums(rows, "cost", "item", "text", "piece").select("item", "text", F.floor(F.col("before") / set_bytes).cast("int").alias("set")))


def _scanner(shared, k: int, again: bool, most_hit: float | None):
    """Texts in column k. again: the last three columns hold what earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            columns = batch.columns[:-3] if again else batch.columns
            old_spans, old_items = batch.columns[-2:] if again else (None, None)
            raw, at = flat_text(columns[k])
            n_words, spans, items = [], [], []
            for i, j in blocks(at):
                for doc, n, found, held in grams.scan(raw[at[i] : at[j]], at[i : j + 1] - at[i]):
                    if again:
                        before = old_spans[i + doc].as_py()
                        found = merge([*found, *zip(before[::2], before[1::2], strict=True)])
                        held = held | set(old_items[i + doc].as_py())
                    n_words.append(n)
                    spans.append(found)
                    items.append(sorted(held, key=lambda x: (x is None, x or "")))
            if most_hit is None:
                new = [pa.array(n_words, pa.int64()), pa.array([[x for s in found for x in s] for found in spans], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=[*batch.schema.names[: len(columns)], "__n", "__spans", "__items"])
                continue
            if any(spans):
                texts = pa.array([clean_text(columns[k][d].as_py(), found) if found else columns[k][d].as_py() for d, found in enumerate(spans)], pa.string())
                kept = pa.array([sum(b - a for a, b in found) <= n * most_hit for n, found in zip(n_words, spans, strict=True)], pa.bool_())
                columns = [(texts if c == k else x).filter(kept) for c, x in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(columns)])

    return run


def clean_text(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the hit words; what stands between two hit words of a span goes too."""
    if text is None or not spans:
        return text
    data = text.encode()
    raw = LOWER[np.frombuffer(data, np.uint8)]
    starts, ends, _ = cut_words(raw, np.array([0, len(raw)]), WORD_BYTES)
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : starts[a]])
        last = int(ends[b - 1])
    out.append(data[last:])
    return b"".join(out).decode()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", most_hit: float = 0.5, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """docs (its columns, whatever their names) without hit spans; documents go whose words are hit by more than most_hit."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = _scanned(plain, items, f"c{docs.columns.index(text)}", item_id, item_text, window, set_bytes, most_hit)
    return out.toDF(*docs.columns)


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
