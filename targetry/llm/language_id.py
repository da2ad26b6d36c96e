"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams, trained with the
follow-the-regularised-leader method under an elastic-net penalty, then calibrated by one temperature.

Document frequencies are counted over all learning documents. The regression is fitted on at most MAX_ROWS of them, and
MAX_BYTES of features, drawn by a hash of key and row number with a rate for each language, so that rare languages are
kept. A tenth of these rows is held back for the temperature.

Null texts and texts without a letter get `und` and score 0; so does every text when there is nothing to learn from.
Repeated rows are scored each on its own; of equal probabilities the first language in order counts. Long texts are read
whole. An empty table gives an empty result. Columns other than the text, the label and the key are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from targetry.llm.common import forget, lean, store

#: Hashed features: 2**BITS, and one for the bias.
BITS = 15
ORDERS = (1, 2, 3)
#: Labelled rows to fit on and bytes of their features, at most; the rows are shared out about evenly over the languages.
MAX_ROWS, MAX_BYTES = 6000, 256 << 20
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
_BLOCK_CHARS = 1 << 20


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Feature numbers and counts of each text; None for those without a letter."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < _BLOCK_CHARS):
            size += len(texts[j] or "")
            j += 1
        low = [(t or "").lower() for t in texts[i:j]]
        ends = np.cumsum([len(t) for t in low])
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
        odd = (codes < 128) & ((codes < 97) | (codes > 122))
        codes = np.where(odd, np.uint32(32), codes)  # ASCII that isn't a letter says nothing about the language
        grams, h = [], np.zeros(len(codes), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
            if n in ORDERS:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
                grams.append((n, (x >> np.uint32(32 - BITS)).astype(np.int32)))
        start = 0
        for t, end in zip(low, ends.tolist(), strict=True):
            if any(map(str.isalpha, t)):
                counts = np.bincount(np.concatenate([g[start : max(start, end - n + 1)] for n, g in grams]), minlength=1 << BITS)
                where = np.flatnonzero(counts)
                yield where, counts[where]
            else:
                yield None
            start = end
        i = j


class Model:
    """Weights by feature and language, document frequencies' logarithms, and the temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.weights = np.zeros(((1 << BITS) + 1, len(languages)))

    def vector(self, where: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.log1p(counts) * self.idf[where]
        x /= np.sqrt(x @ x) or 1.0
        return np.append(where, 1 << BITS), np.append(x, 1.0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> None:
        z, n = np.zeros_like(self.weights), np.zeros_like(self.weights)
        order = np.random.default_rng(seed)
        vectors = [(*self.vector(a, b), y) for a, b, y in rows]

        def at(where: np.ndarray) -> np.ndarray:
            zw = z[where]
            w = -(zw - np.sign(zw) * L1) / ((BETA + np.sqrt(n[where])) / ALPHA + L2)
            w[np.abs(zw) <= L1] = 0
            return w

        for _ in range(EPOCHS):
            for k in order.permutation(len(vectors)).tolist():
                where, x, y = vectors[k]
                w = at(where)
                p = softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p
                old = n[where]
                new = old + g * g
                z[where] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
                n[where] = new
        self.weights = at(np.arange(len(z)))

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """The temperature that makes the held-back rows likeliest: golden-section search on its logarithm."""
        if not rows:
            return
        logits = np.stack([x @ self.weights[w] for w, x in (self.vector(a, b) for a, b, _ in rows)])
        y = np.array([r[2] for r in rows])

        def loss(t: float) -> float:
            s = logits / np.exp(t)
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

        a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            c, d = b - ratio * (b - a), a + ratio * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        self.temperature = float(np.exp((a + b) / 2))

    def predict(self, where: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        w, x = self.vector(where, counts)
        p = softmax(x @ self.weights[w] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, p[k]))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """docs: the learning documents; those without a label are passed over."""
    rows = docs.where(F.col(lang).isNotNull())
    seen = {r.lang: r.n for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(seen)
    share = max(1, max_rows // max(1, len(languages)))
    rate = {k: min(1.0, share / n) for k, n in seen.items()}
    number = {k: i for i, k in enumerate(languages)}
    # the row's number is part of the draw, so rows that repeat are drawn each on its own
    draw = (F.pmod(F.xxhash64(F.lit(11), F.col(key).cast("string"), F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)
        n = 0
        for batch in batches:
            texts, langs, us = (c.to_pylist() for c in batch.columns)
            kept = []
            for found, language, u in zip(features(texts), langs, us, strict=True):
                if found is None:
                    continue
                where, counts = found
                df[where] += 1
                n += 1
                if u < rate[language]:
                    kept.append((number[language], u, where.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
            if kept:
                y, u, where, counts = zip(*kept, strict=True)
                none = [None] * len(kept)
                yield pa.RecordBatch.from_arrays([pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(y, pa.int32()), pa.array(u, pa.float64()), pa.array(where, pa.binary()), pa.array(counts, pa.binary())], names=names)
        where = np.flatnonzero(df)
        ids, sums = np.append(where, 1 << BITS), np.append(df[where], n)
        none = pa.nulls(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(sums, pa.int64()), none.cast(pa.int32()), none.cast(pa.float64()), none.cast(pa.binary()), none.cast(pa.binary())], names=names)

    names = ["feature", "df", "y", "u", "where", "counts"]
    found = store(rows.select(text, lang, draw).mapInArrow(run, "feature int, df long, y int, u double, where binary, counts binary"))
    idf = np.ones(1 << BITS)
    sums = {r.feature: r.df for r in found.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("df").alias("df")).collect()}
    total = sums.pop(1 << BITS, 0)
    for f, df in sums.items():
        idf[f] = np.log((1 + total) / (1 + df)) + 1
    # at most max_rows of what was drawn, and MAX_BYTES of their features: the cut is decided on their sizes
    place = F.col("u") / F.element_at(F.array(*[F.lit(rate[k]) for k in languages] or [F.lit(1.0)]), F.col("y") + 1)
    drawn = found.where("y IS NOT NULL").select("y", place.alias("place"), "where", "counts")
    sizes = drawn.select("place", (F.octet_length("where") * 3).alias("size")).orderBy("place").limit(max_rows).collect()
    bytes_ = np.cumsum([r.size for r in sizes])
    most = int(np.searchsorted(bytes_, MAX_BYTES, "right"))
    kept = drawn.where(F.col("place") <= sizes[most - 1].place).orderBy("place", "y", F.xxhash64("where", "counts")).limit(most).collect() if most else []
    sample = [(np.frombuffer(r["where"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(float), r.y, r.place) for r in kept]
    forget(found)
    sample.sort(key=lambda r: (r[3], r[2], len(r[0])))
    model = Model(languages, idf)
    if sample:
        held = max(1, len(sample) // 10) if len(sample) >= 20 else 0
        every = {i * (len(sample) // held) for i in range(held)} if held else set()
        model.fit([r[:3] for i, r in enumerate(sample) if i not in every])
        model.calibrate([r[:3] for i, r in enumerate(sample) if i in every])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced); prefix goes before the two names."""
    pred, score = f"{prefix}lang_pred", f"{prefix}score"
    docs = docs.drop(pred, score)
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [("und", 0.0) if f is None or not model.languages else model.predict(*f) for f in features(batch.column(k).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names, pred, score])

    schema = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(run, schema)


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo by; null keys count as -1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % by, F.lit(-1))
