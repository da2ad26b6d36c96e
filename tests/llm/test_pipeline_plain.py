"""The pipeline's stages in order against brute-force versions, each on its own input."""

import random
import re

import corpus_pipeline
from targetry.llm import pii, quality
from targetry.llm.common import flat_text, table

import pyarrow as pa

WORDS = ["ra" + a + b for a in "abcdefgh" for b in "mnopqrst"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def keepers(rows):
    """Ids that stay of near-duplicate groups: the smallest of each."""

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows.items()}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in rows:
        for j in rows:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in rows if find(i) == i}


def without(text, items):
    """text without benchmark windows, and whether it stays."""
    if text is None:
        return None, True
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    words = [text[a:b].lower() for a, b in places]
    hit = [False] * len(words)
    for item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item.lower())
        k = min(10, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                hit[i : i + k] = [True] * k
    out, last, i = [], 0, 0
    while i < len(words):
        if hit[i]:
            j = i
            while j < len(words) and hit[j]:
                j += 1
            out.append(text[last : places[i][0]])
            last, i = places[j - 1][1], j
        else:
            i += 1
    return "".join(out) + text[last:], sum(hit) <= len(words) * 0.5


def redacted(text):
    (_, spans), out, last = pii.find([text or ""], pii.trained())[0], "", 0
    for kind, a, b in spans:
        if a >= last:
            out += (text or "")[last:a] + f"<{kind.upper()}>"
        last = max(last, b)
    return None if text is None else out + text[last:]


def test_stages_against_plain_versions(spark, tmp_path):
    d, r = str(tmp_path), random.Random(5)
    items = [prose(25, 900), prose(6, 901)]
    docs = []
    for i in range(90):
        t = prose(60, i // 2 if i % 3 == 0 else 1000 + i)
        t = t.upper().replace(" ", "!! ") if i % 6 == 1 else t.replace(" ", " vileword ", 4) if i % 6 == 5 else t
        if i % 9 == 4:
            t += " " + items[i % 2] + " " + prose(5, i)
        if i % 9 == 2:
            t = t.replace(" ", r.choice([" bob.x@mail.org ", " 10.1.2.3, ", " +1 (415) 555-0132 "]), 2)
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, items[0]), (203, items[1])]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 6 != 1), int(i % 6 == 5)) for i in range(70)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stages, now = [f for _, f in corpus_pipeline.STAGES], table(spark, d, "documents")

    def run(k):
        nonlocal now
        stages[k](spark, now, d).write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        return {x.doc_id: x.text for x in now.collect()}

    texts = dict(docs)
    model = quality.train(table(spark, d, "documents"), labels)
    grade = {i: model.grade(f)[1] for i, f in zip(texts, quality.features(*flat_text(pa.array(list(texts.values())))), strict=True)}
    want = {i: t for i, t in texts.items() if grade[i] >= quality.THRESHOLD}
    assert run(0) == want and 40 < len(want) < 90
    kept = keepers({i: t for i, t in want.items()})
    want = {i: t for i, t in want.items() if i in kept}
    assert run(1) == want
    want = {i: c for i, t in want.items() for c, stays in [without(t, items)] if stays}
    assert run(2) == want
    want = {i: redacted(t) for i, t in want.items()}
    assert run(3) == want and any("<EMAIL>" in (t or "") for t in want.values())
    run(4)
    out, sizes = now.collect(), {}
    for i, t in want.items():
        sizes[f"s{i % 3}"] = sizes.get(f"s{i % 3}", 0) + len((t or "").split())
    targets, weights, open_ = {}, dict(zip(sorted(sizes), (5, 2, 1), strict=False)), set(sizes)
    left = sum(sizes.values())
    while True:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            targets |= share
            break
        targets |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    for s in sizes:
        mine = [x for x in out if x.source == s]
        assert abs(sum(x.mix_words for x in mine) - targets[s]) <= 1
        assert all(x.text == want[x.doc_id] or x.text == " ".join(want[x.doc_id].split()[: x.mix_words]) for x in mine)
        assert max((sum(1 for y in mine if y.doc_id == x.doc_id) for x in mine), default=0) <= 3
