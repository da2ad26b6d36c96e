"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random

import pytest

from targetry.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    nodes: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = [q for q in nodes if q[: len(path)] == path]
        kids = sum(len(q) == len(path) + 1 for q in under)
        leaves = sum(not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in nodes) for q in under)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        above = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), above, len(members), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, kind="conv_id long, turn long, role string, text string"):
    table = spark.createDataFrame(rows, kind)
    return sorted((tuple(r) for r in prefix_trie.trie(prefix_trie.sequences(table)).select(*COLUMNS).collect()), key=str)


def rows_of(convs):
    return [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]


@pytest.mark.parametrize(("block", "fan"), [(8192, 64), (1, 2), (3, 2), (7, 3)])
def test_against_all_prefixes(spark, monkeypatch, block, fan):
    monkeypatch.setattr(prefix_trie, "BLOCK_SEQUENCES", block)
    monkeypatch.setattr(prefix_trie, "FAN_IN", fan)
    r = random.Random(block)
    convs = {}
    for c in r.sample(range(-2000, 9000), 150):
        convs[c] = [("u", r.choice("abü")) for _ in range(r.randrange(1, 7))] if r.random() < 0.7 else [("u", "a"), ("v", "b")] * r.randrange(1, 9)
    for c in range(20_000, 20_060):  # copies of one
        convs[c] = [("u", "a"), ("v", "b"), ("u", "long " * 50)]
    assert got(spark, rows_of(convs)) == plain(convs)


@pytest.mark.parametrize("shape", ["one", "alike", "chain", "no common turn"])
def test_shapes(spark, monkeypatch, shape):
    monkeypatch.setattr(prefix_trie, "BLOCK_SEQUENCES", 2)
    monkeypatch.setattr(prefix_trie, "FAN_IN", 2)
    convs = {
        "one": {5: [("u", "x"), ("v", "y")]},
        "alike": {c: [("u", "x"), ("v", "y")] for c in range(30)},
        "chain": {c: [("u", "x")] * (c + 1) for c in range(23)},
        "no common turn": {c: [("u", str(c)), ("v", "y")] for c in range(17)},
    }[shape]
    assert got(spark, rows_of(convs)) == plain(convs)


def test_odd_rows(spark):
    rows = [(1, 0, None, None, 9), (1, None, "u", "first", 9), (1, 1, "u", "", 9), (2, 5, "u", "first", 9), (2, 7, "", "", 9), (2, 7, "", "", 9), (None, 1, "u", "x", 9)]
    convs = {1: [("u", "first"), ("", ""), ("u", "")], 2: [("u", "first"), ("", ""), ("", "")]}
    assert got(spark, rows, "conv_id long, turn long, role string, text string, depth int") == plain(convs)
    assert got(spark, []) == []


def test_conversations_without_turns(spark):
    seqs = spark.createDataFrame([(3, []), (1, []), (7, [("a" * 32, 4)])], "conv_id long, turns array<struct<code:string,size:long>>")
    found = sorted(tuple(r) for r in prefix_trie.trie(seqs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found == [(1, 0, None, 3, 1, 1, 0, sha("1,3")), (7, 1, 1, 1, 0, 1, 0, sha("7"))]


def test_many_ids_and_long_conversation(spark):
    convs = {c: [("u", "x")] for c in range(0, 9000, 2)} | {9001: [("u", "x")] + [("v", str(k % 3)) for k in range(3000)]}
    found = got(spark, rows_of(convs))
    assert len(found) == 3002
    top = next(r for r in found if r[1] == 1)
    ends = ",".join(map(str, range(0, 9000, 2)))
    assert top == (0, 1, 0, 4501, 1, 1, 4500, hashlib.sha256(ends.encode()).hexdigest())
    assert sum(r[3] for r in found) == 4501 * 2 + 3000
