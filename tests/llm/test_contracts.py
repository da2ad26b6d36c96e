"""Registered queries without SQL, as they are registered, against plain versions of what they return for a document."""

import collections
import hashlib
import math
import os
import re
import zlib

import pyarrow.parquet as pq
import pytest

from targetry.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def run(spark, name):
    rows = [r.asDict() for r in queries.queries()[name](spark, SF).collect()]
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def held_out(doc, modulus):
    return zlib.crc32(str(doc["doc_id"]).encode()) % modulus == 2


def test_op2_mixing(spark, docs):
    found = run(spark, "op2_mixing")
    size = {d["doc_id"]: len(TOKEN.findall(d["text"] or "")) for d in docs}
    total = collections.Counter()
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * total[s]}
        target |= {s: 3 * total[s] for s in over} if over else share
        open_ -= over or open_
    taken = collections.Counter()
    for d in docs:
        r = found.pop(d["doc_id"])
        assert r["size"] == size[d["doc_id"]] and r["source_size"] == total[d["source"]]
        assert math.isclose(r["target"], target[d["source"]], rel_tol=1e-9) and 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    assert not found and all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_op4_language_id(spark, docs):
    found = run(spark, "op4_language_id")
    learned = {d["lang"] for d in docs if d["lang"] is not None and not held_out(d, 4)}
    right = []
    for d in docs:
        r = found.pop(d["doc_id"])
        letters = any(c.isalpha() for c in d["text"] or "")
        assert r["held_out"] == held_out(d, 4) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned if letters else r["lang_pred"] == "und"
        if r["held_out"] and d["lang"] is not None and letters and len(d["text"]) > 200:
            right.append(r["lang_pred"] == d["lang"])
    assert not found and sum(right) >= 0.9 * len(right)


def test_op5_lm_score(spark, docs):
    found = run(spark, "op5_lm_score")
    words = {d["doc_id"]: [*TOKEN.findall((d["text"] or "").translate(LOWER)), None] for d in docs}
    count = collections.Counter(w for d in docs if not held_out(d, 7) for w in words[d["doc_id"]])
    n, v = sum(count.values()), len(count)
    for d in docs:
        r, own = found.pop(d["doc_id"]), words[d["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(d, 7), len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert not found


def test_op6_quality(spark, docs):
    found = run(spark, "op6_quality")
    bad = {x["doc_id"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist() if x["toxic"] == 1}
    assert set(found) == {d["doc_id"] for d in docs}
    assert all(0 <= r["p_top"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in found.values())
    assert sum(found[d]["keep"] for d in bad & set(found)) <= 0.1 * len(bad)


def test_op8_license_scan(spark, docs):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    found = run(spark, "op8_license_scan")
    for d in docs:
        r, words = found.pop(d["doc_id"]), WORD.findall((d["text"] or "").translate(LOWER))
        places = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        labels = sorted({label for _, label in places})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(labels) <= set(r["labels"].split(",")) if labels else True
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) and 0 <= r["score"] <= 1
    assert not found


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def test_op9_pii(spark, docs):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(x := re.sub("[^0-9]", "", s)) <= 19 and luhn(x)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    found = run(spark, "op9_pii")
    for d in docs:
        r, text = found.pop(d["doc_id"]), d["text"] or ""
        spans = [(m.start(), i, m.end()) for i, (_, p, fits) in enumerate(kinds) for m in re.finditer(p, text) if fits(m[0])]
        assert [r[f"n_{k}"] for k, *_ in kinds] == [sum(i == j for _, i, _ in spans) for j in range(4)]
        listed = [f"{kinds[i][0]}:{s}:{e}" for s, i, e in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(","))  if listed else True
    assert not found
