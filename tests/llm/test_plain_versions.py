"""Models, rules and bounds against plain versions on small inputs, and columns whose names clash."""

import itertools
import math
import pickle
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from targetry.llm import decontam, embedding_dedup, jaccard, language_id, licenses, lm_score, mixing, pii, quality, url_filter

WORDS = ["lo" + a + b for a in "abcdefgh" for b in "mnopqrst"]
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "é"), (4, "é"), (None, "x y"), (7, "!!")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


# --- 9: Viterbi ---


def test_viterbi_against_all_paths():
    field, r = pii.trained(), random.Random(2)
    tokens = ["mail", "bob@x.org", "(at)", "4111", "+1", "10.0.0.1", "the", "key=ab12cd34ef", "at", "9:30"]
    n = len(pii.LABELS)
    for size in (1, 2, 3):
        words = [r.choice(tokens) for _ in range(size)]
        emit = field.emit[np.array(pii._features(words))].sum(1)

        def value(path, emit=emit):
            return field.start[path[0]] + sum(emit[k, y] for k, y in enumerate(path)) + sum(field.move[a, b] for a, b in itertools.pairwise(path))

        best = max(value(p) for p in itertools.product(range(n), repeat=size))
        assert math.isclose(value(field.decode([words])[0].tolist()), best, rel_tol=1e-12)


def test_field_gives_the_same_in_a_batch_and_in_pieces(monkeypatch):
    field = pii.trained()
    text = prose(30, 1) + " card 4111 1111 1111 1112 call 020 7946 0018 or 5105-1051-0510-5101 " + " ".join(str(k % 7) for k in range(300)) + " token=9f8e7d6c5b4a tail"
    whole = pii.find([text, "x", text], field)
    assert whole[0] == whole[2]
    monkeypatch.setattr(pii, "MOST_RUN", 80)
    monkeypatch.setattr(pii, "MOST_WORDS", 100)
    assert pii.find([text], field)[0] == whole[0]


# --- 6, 4: follow the regularised leader, step by step over dicts ---


def test_ordinal_steps_against_plain_version():
    r = random.Random(3)
    rows = [(np.array(sorted(r.sample(range(40), 6)) + [quality.FEATURES - 1]), r.randrange(3)) for _ in range(60)]
    z, n, first, gap, done = Counter(), Counter(), -1.0, math.log(2.0), 0
    sigma = lambda x: 1 / (1 + math.exp(-x))

    def weight(f):
        if abs(z[f]) <= quality.L1:
            return 0.0
        return -(z[f] - math.copysign(quality.L1, z[f])) / ((quality.BETA + math.sqrt(n[f])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(5)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(rows)).tolist():
            where, y = rows[k]
            w = {f: weight(f) for f in where.tolist()}
            s = sum(w.values())
            cuts = [first - s, first + math.exp(gap) - s]
            high, low = (1.0 if y == 2 else sigma(cuts[y])), (0.0 if y == 0 else sigma(cuts[y - 1]))
            p = max(high - low, 1e-9)
            dh, dl = high * (1 - high), low * (1 - low)
            g = (dh - dl) / p
            for f in where.tolist():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / quality.ALPHA * w[f]
                n[f] += g * g
            step, by = 0.05 / math.sqrt(1 + done / 200), [0.0, 0.0]
            if y < 2:
                by[y] -= dh / p
            if y > 0:
                by[y - 1] += dl / p
            first -= step * min(5, max(-5, sum(by)))
            gap -= step * min(5, max(-5, by[1] * math.exp(gap)))
            done += 1
    model = quality.Model()
    model.fit(list(rows))
    assert np.allclose(model.thresholds, [first, first + math.exp(gap)])
    assert all(math.isclose(model.weights[f], weight(f), abs_tol=1e-9) for f in [*range(40), quality.FEATURES - 1])


def test_language_steps_and_features_against_plain_version():
    def plain_features(text):
        low = "".join(c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in text.lower())
        out = Counter()
        for size in language_id.ORDERS:
            for i in range(len(low) - size + 1):
                h = 0
                for k, c in enumerate(low[i : i + size]):
                    h = (h * 0x01000193 + ord(c) + k + 1) % 2**32
                out[((h ^ h >> 15) * 0x9E3779B1 % 2**32) >> (32 - language_id.BITS)] += 1
        return out

    texts = ["Der Hund, die Katze!", "le chien é", "a", "x1y " * 50]
    for text, (where, counts) in zip(texts, language_id.features(texts), strict=True):
        assert dict(zip(where.tolist(), counts.tolist(), strict=True)) == plain_features(text)
    rows = [(*f, k % 2) for k, f in enumerate(language_id.features(texts * 6))]
    model = language_id.Model(["a", "b"], np.ones(1 << language_id.BITS))
    model.fit(rows)
    z, n = Counter(), Counter()

    def weight(f):
        a = language_id
        return 0.0 if abs(z[f]) <= a.L1 else -(z[f] - math.copysign(a.L1, z[f])) / ((a.BETA + math.sqrt(n[f])) / a.ALPHA + a.L2)

    order = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for k in order.permutation(len(rows)).tolist():
            where, counts, y = rows[k]
            raw = [math.log1p(c) for c in counts.tolist()]
            norm = math.sqrt(sum(v * v for v in raw))
            x = dict(zip([*where.tolist(), 1 << language_id.BITS], [*[v / norm for v in raw], 1.0], strict=True))
            w = {(f, c): weight((f, c)) for f in x for c in (0, 1)}
            logits = [sum(v * w[f, c] for f, v in x.items()) for c in (0, 1)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for c in (0, 1):
                slope = e[c] / sum(e) - (c == y)
                for f, v in x.items():
                    g = v * slope
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / language_id.ALPHA * w[f, c]
                    n[f, c] += g * g
    assert all(math.isclose(model.weights[f, c], weight((f, c)), abs_tol=1e-9) for f, c in n)


# --- 4, 6: the bounds of the fits hold for rows that repeat ---


def test_fits_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.Model, "fit", lambda self, rows, seed=7: seen.append(len(rows)))
    monkeypatch.setattr(language_id.Model, "calibrate", lambda self, rows: seen.append(len(rows)))
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("der hund").alias("text"), F.lit("de").alias("lang"))
    language_id.train(same, max_rows=600)
    assert 300 < sum(seen) <= 600
    seen.clear()
    monkeypatch.setattr(quality.Model, "fit", lambda self, rows, seed=5: seen.append(len(rows)))
    docs = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("some text").alias("text"))
    rated = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    quality.train(docs, rated, max_rows=500)
    quality.train(docs, rated, max_rows=500, max_bytes=900)
    assert seen == [500, 100]


# --- 8: the rules one by one ---


def test_license_rules_against_plain_version(spark):
    table, r = list(licenses.rules()), random.Random(4)
    pieces = ["licensed under the GNU GPL v3 or later", "MIT License", "apache license version 2.0", "cc by nc sa 4.0", "creative commons attribution", "All rights reserved", "copyright 2020", "distributed under BSD", "mozilla public license 2.0", "the eclipse public license", "spdx license identifier apache 2 0", "without warranty of any kind", "zlib", "license"]
    rows = [(i, " ".join(r.choice([*pieces, prose(3, i * 50 + k)]) for k in range(r.randint(1, 9)))) for i in range(60)]
    got = {x.doc_id: [(f.start, f.end, f.priority, f.label) for f in x.found] for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        joined = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) + " "
        found = []
        for label, keyword, pattern, priority, _ in table:
            if f" {keyword} " in joined:
                found += [(joined[: m.start()].count(" "), joined[: m.end()].count(" "), priority, label) for m in re.finditer(f" (?:{pattern})(?= )", joined)]
        found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3]))
        kept = []
        for d in found:
            if not any(o[0] <= d[0] and d[1] <= o[1] and o[2] >= d[2] for o in kept):
                kept.append(d)
        assert got[i] == kept, text


# --- columns whose names clash, rows that repeat, empty tables ---


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, "s", "en", "u") for i, t in ODD], "doc_id long, text string, source string, lang string, c string")
    names = ["n", "cls", "num", "s", "k", "id", "mark", "a", "b", "c0", "c1", "_row", "size", "target", "words", "spans", "n_tokens", "keep", "score", "_text", "block", "comp", "leaf"]
    wide = docs
    for n in names:
        wide = wide.withColumn(n, F.lit("own"))
    items = spark.createDataFrame([(1, prose(12, 1))], "item_id long, text string")
    rated = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    none = docs.limit(0)
    for df, size in ((wide, len(ODD)), (none, 0)):
        same = lambda out, df=df, size=size: (out.columns == df.columns and out.count() == size)
        assert same(decontam.decontaminate(df, items)) and same(pii.redact(df))
        assert jaccard.deduplicate(df).columns == df.columns
        assert jaccard.join(df).count() == mixing.mix(df).count() == size
        assert quality.score(df, quality.train(df, rated)).count() == licenses.scan(df).count() == pii.scan(df).count() == size
        assert language_id.identify(df, language_id.train(df)).count() == size
        assert decontam.scan(df, items).count() == decontam.scan(df, items.limit(0)).count() == size
        scored = lm_score.score(df, F.col("doc_id") > 1)
        assert scored.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and scored.count() == size
    vectors = spark.createDataFrame([(1, [1e200, 2e200], "x"), (2, [1e200, 2.0001e200], "x"), (3, [1e-170, 2e-170], "x"), (4, [1.0, -1.0], "x"), (5, None, "x"), (6, [0.0, 0.0], "x")], "vec_id long, embedding array<double>, cls string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
    pages = spark.createDataFrame([(1, "http://a.com/en/" + "x" * 100_000, "y"), (1, None, "y")], "page_id long, url string, host string")
    assert url_filter.filter_urls(pages, [url_filter.Rule("block", "com", "/en/")]).count() == 2


def test_lm_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_tokens int")
    out = lm_score.score(docs, F.lit(True), carry=("doc_id", "n_tokens"))
    assert sorted(out.columns) == sorted(set(out.columns))


def test_decontamination_of_several_sets(spark):
    items = spark.createDataFrame([(i, prose(14, i)) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(100 + i, prose(5, 50 + i) + " " + prose(14, i) + " " + prose(14, (i + 1) % 9)) for i in range(9)], "doc_id long, text string")
    plain = lambda out: sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in out.collect())
    one, many = decontam.scan(docs, items), decontam.scan(docs, items, set_bytes=150)
    assert plain(one) == plain(many) and all(len(r[3]) >= 2 for r in plain(one))
    assert sorted(map(tuple, decontam.decontaminate(docs, items, most_hit=1.0).collect())) == sorted(map(tuple, decontam.decontaminate(docs, items, most_hit=1.0, set_bytes=150).collect()))


def test_decontamination_set_takes_little_memory():
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(50_000)]
    items, total = [], 0
    while total < 32 << 20:
        items.append((str(len(items)), " ".join(r.choices(vocabulary, k=2_000))))
        total += len(items[-1][1])
    grams = decontam.Grams(iter(items))
    assert grams.nbytes() <= 8 * total and len(pickle.dumps(grams)) <= 8 * total
    text = " ".join(items[7][1].split()[50:75])
    (found,) = grams.scan(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert found == (0, 25, [(0, 25)], {"7"})


def test_decontamination_windows_that_share_a_hash(monkeypatch):
    real = decontam.window_hashes

    def weak(*a):
        hashes, where = real(*a)
        return hashes & np.uint64(7), where

    items = [("a", prose(30, 1)), ("b", prose(30, 2)), (None, prose(30, 1)), ("c", "two words"), ("d", "other words"), ("e", None), ("a", prose(12, 3))]
    text = prose(30, 1) + " x " + prose(12, 3) + " other words " + " ".join(prose(30, 2).split()[5:15])
    raw, at = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    want = list(decontam.Grams(items).scan(raw, at))
    assert want[0][3] == {"a", None, "b", "d"} and want[0][2] == [(0, 30), (31, 55)]
    monkeypatch.setattr(decontam, "window_hashes", weak)
    grams = decontam.Grams(items)
    assert len(grams.layers) > 4 and list(grams.scan(raw, at)) == want


def test_decontamination_by_an_item_larger_than_a_set(spark):
    long = prose(400, 5)
    items = spark.createDataFrame([(1, long), (2, "short one"), (2, "short one"), (3, None), (4, prose(11, 6))], "item_id long, text string")
    cut = long.split()
    docs = spark.createDataFrame([(k, "so " + " ".join(cut[k : k + 10]) + " far") for k in range(391)] + [(900, long), (901, " ".join(cut[:9])), (902, "a short one")], "doc_id long, text string")
    plain = lambda out: sorted((r.doc_id, [tuple(s) for s in r.spans], r["items"]) for r in out.collect())
    one = plain(decontam.scan(docs, items))
    assert one == plain(decontam.scan(docs, items, set_bytes=700)) and sum(bool(r[1]) for r in one) == 393
    assert one[0][1] == [(1, 11)] and one[-3][1] == [(0, 400)]


def test_license_detections_of_a_long_text_take_time_in_proportion(spark):
    def seconds(n):
        text = F.repeat(F.lit("licensed under the gnu gpl v3 license or later and so on "), n).alias("text")
        start = time.perf_counter()
        found = licenses.scan(spark.range(1).select(text)).select("found", "words").first()
        assert found.words == 12 * n and [(x.start, x.end) for x in found.found] == [(12 * k + found.found[0].start, 12 * k + found.found[0].end) for k in range(n)]
        return time.perf_counter() - start

    seconds(100)
    half = min(seconds(10_000), seconds(10_000))
    assert min(seconds(20_000), seconds(20_000)) <= 2.5 * half


def test_license_sweep_over_several_blocks(spark, monkeypatch):
    r = random.Random(9)
    pieces = ["licensed under the GNU GPL v3 or later", "MIT License", "apache license version 2.0", "cc by nc sa 4.0", "spdx license identifier apache 2 0", "zlib", "released under the mit license"]
    docs = spark.createDataFrame([(i, " ".join(r.choice([*pieces, prose(2, i + k)]) for k in range(40))) for i in range(12)], "doc_id long, text string")
    one = sorted(map(str, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "SWEPT", 3)
    assert sorted(map(str, licenses.scan(docs).collect())) == one
