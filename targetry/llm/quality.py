"""Quality by ordinal cumulative-link regression: P(grade <= k) = logistic(threshold_k - w.x), one weight vector over
hashed words and a few hashed shape features, and ordered thresholds. The expected grade and the probability of the top
grade follow; documents below a top-grade probability are rejected.

Grades come from ratings: 0 toxic, 1 not toxic and of low quality, 2 neither. Fitted on at most MAX_ROWS rated documents
with MAX_BYTES of text, drawn by a hash of id and row number. Ratings with a null are passed over; several ratings of one
document all count.

Null and empty texts have only their shape features. Without any rating there is no grade: expected_grade and p_top are
null and every document is kept. Repeated rows are judged each on its own; a probability equal to the threshold is kept.
Long texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.llm.common import LOWER, U64, WORD_BYTES, blocks, cut_words, flat_text, lean, word_hashes

BITS = 18
GRADES = 3
#: Rated documents to fit on and bytes of their texts, at most.
MAX_ROWS, MAX_BYTES = 10_000, 64 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2.0, 1e-3
#: Documents whose top grade is less likely than this are rejected.
THRESHOLD = 0.5

_CLASS = np.zeros(256, np.uint8)  # 0 other control, 1 space, 2 lower, 3 upper, 4 digit, 5 sentence marks, 6 symbols, 7 non-ASCII
_CLASS[33:128] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[[ord(c) for c in ",.;:'\"()?-"]] = 5
_SHAPES = 14
#: ASCII symbols, each with its share of the text.
_SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_BUCKETS = 16
FEATURES = (1 << BITS) + (_SHAPES + len(_SYMBOLS)) * _BUCKETS + 1
#: Bytes of the word beginnings that are features beside the words.
BEGINNINGS = (5, 7)
#: Features of fewer rated documents get no weight.
LEAST_DOCS = 8


def features(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct feature numbers of each text; each feature has the value 1."""
    for i, j in blocks(at):
        part, ends = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        low = LOWER[part]
        starts, stops, first = cut_words(low, ends, WORD_BYTES)
        hashes = word_hashes(low, starts, stops)
        ids = (hashes >> U64(64 - BITS)).astype(np.int64)
        begins = [(word_hashes(low, starts, np.minimum(stops, starts + b)) * U64(2 * b + 1) >> U64(64 - BITS)).astype(np.int64) for b in BEGINNINGS]
        again = np.append(False, hashes[1:] == hashes[:-1])
        classes = _CLASS[part]
        for k in range(j - i):
            own = slice(first[k], first[k + 1])
            n = int(first[k + 1] - first[k])
            size = max(1, int(ends[k + 1] - ends[k]))
            by = np.bincount(classes[ends[k] : ends[k + 1]], minlength=8)
            words = np.unique(ids[own])
            parts = np.unique(np.concatenate([words, *[b[own] for b in begins]]))
            symbols = np.bincount(part[ends[k] : ends[k + 1]], minlength=256)[_SYMBOLS] / size
            letters = max(1, int(by[2] + by[3]))
            shares = [*(by[[0, 1, 4, 5, 6, 7]] / size), by[3] / letters, 1 - len(words) / max(1, n), again[own].sum() / max(1, n), n / size, by[6] / max(1, n), by[5] / max(1, n), 1 / max(1, n), 0 if n else 1]
            buckets = np.minimum(_BUCKETS - 1, np.log2(1 + np.concatenate([shares, symbols]) * 1024)).astype(np.int64)
            yield np.concatenate([parts, (1 << BITS) + np.arange(len(buckets)) * _BUCKETS + buckets, [FEATURES - 1]])


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights by feature and GRADES - 1 ordered thresholds."""

    def __init__(self) -> None:
        self.weights = np.zeros(FEATURES)
        self.thresholds = np.array([-1.0, 1.0])
        self.fitted = False

    def fit(self, rows: list[tuple[np.ndarray, int]], seed: int = 5) -> None:
        """Follow-the-regularised-leader for the weights, plain gradient steps for the first threshold and the gaps."""
        z, n = np.zeros(FEATURES), np.zeros(FEATURES)
        seen = np.zeros(FEATURES, np.int64)
        for where, _ in rows:
            seen[where] += 1
        least = min(LEAST_DOCS, max(1, len(rows) // 50))
        for i, (where, y) in enumerate(rows):  # in place: the driver holds one copy
            rows[i] = where[seen[where] >= least], y
        first, gap = -1.0, np.log(2.0)

        def at(where):
            zw = z[where]
            w = -(zw - np.sign(zw) * L1) / ((BETA + np.sqrt(n[where])) / ALPHA + L2)
            w[np.abs(zw) <= L1] = 0
            return w

        rng, done = np.random.default_rng(seed), 0
        for _ in range(EPOCHS):
            for k in rng.permutation(len(rows)).tolist():
                where, y = rows[k]
                w = at(where)
                s = w.sum()
                cuts = np.array([-np.inf, first, first + np.exp(gap), np.inf])
                high, low = (1.0 if y == GRADES - 1 else logistic(cuts[y + 1] - s)), (0.0 if y == 0 else logistic(cuts[y] - s))
                p = max(high - low, 1e-9)
                slope_high, slope_low = high * (1 - high), low * (1 - low)
                g = (slope_high - slope_low) / p  # of -log p by s
                old = n[where]
                new = old + g * g
                z[where] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
                n[where] = new
                step = 0.05 / np.sqrt(1 + done / 200)
                by_cut = np.zeros(2)
                if y < GRADES - 1:
                    by_cut[y] -= slope_high / p
                if y > 0:
                    by_cut[y - 1] += slope_low / p
                first -= step * float(np.clip(by_cut.sum(), -5, 5))
                gap -= step * float(np.clip(by_cut[1] * np.exp(gap), -5, 5))
                done += 1
        self.weights = at(np.arange(FEATURES))
        self.thresholds = np.array([first, first + np.exp(gap)])
        self.fitted = bool(rows)

    def grade(self, where: np.ndarray) -> tuple[float, float]:
        """Expected grade and probability of the top grade."""
        below = logistic(self.thresholds - self.weights[where].sum())
        return float((1 - below).sum()), float(1 - below[-1])


def train(docs: DataFrame, ratings: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", toxic: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """The drawn ratings (at most max_rows rows of an id and a grade) are broadcast to the scan of the documents. Of the
    documents found, the first by a hash of id and row number are read, as many as max_rows and max_bytes of text allow."""
    lean(docs.sparkSession)
    rated = ratings.where(F.col(quality).isNotNull() & F.col(toxic).isNotNull() & F.col(key).isNotNull())
    grade = F.when(F.col(toxic) != 0, 0).when(F.col(quality) == 0, 1).otherwise(2)
    drawn = rated.select(F.col(key).alias("_key"), grade.alias("_grade"), F.xxhash64(F.lit(3), F.col(key).cast("string"), grade).alias("_h")).orderBy("_h", "_grade").limit(max_rows)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    texts = texts.join(F.broadcast(drawn), F.col("_k") == F.col("_key")).select("_text", "_grade", F.xxhash64("_h", "_row").alias("_h"))
    sizes = texts.select("_h", F.coalesce(F.octet_length("_text"), F.lit(0)).alias("size")).orderBy("_h").limit(max_rows).collect()
    most = int(np.searchsorted(np.cumsum([r.size for r in sizes]), max_bytes, "right"))
    last = sizes[most - 1]["_h"] if most else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype("<i4").tobytes() for f in features(*flat_text(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], names=["features", "grade", "h"])

    got = texts.where(F.col("_h") <= F.lit(last)).mapInArrow(run, "features binary, grade int, h long").collect() if most else []
    got.sort(key=lambda r: (r.h, r.grade, r.features))
    rows = [(np.frombuffer(r.features, "<i4"), r.grade) for r in got[:most]]
    del got
    model = Model()
    model.fit(rows)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "", threshold: float = THRESHOLD) -> DataFrame:
    """docs with expected_grade (0 to GRADES - 1), p_top and keep added; columns of these names are replaced."""
    names = [f"{prefix}{c}" for c in ("expected_grade", "p_top", "keep")]
    docs = docs.drop(*names)
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model.fitted:
                got = [model.grade(f) for f in features(*flat_text(batch.column(k)))]
            else:
                got = [(None, None)] * batch.num_rows
            new = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] is None or g[1] >= threshold for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    nothing = F.lit(None)
    schema = docs.select("*", nothing.cast("double").alias(names[0]), nothing.cast("double").alias(names[1]), nothing.cast("boolean").alias(names[2])).schema
    return docs.mapInArrow(run, schema)
