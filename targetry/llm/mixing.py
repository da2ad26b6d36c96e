"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are dealt into blocks by a hash, so a block is a random share of its source. The target of a
source is met by whole passes over its blocks and a part of one more pass, whose last block is cut at a word. The exact
block quotas are then split over the output shards by a multivariate-hypergeometric tree: the root holds all quotas, and
each node gives its left child a hypergeometric draw from each source in turn. A source's permuted block sequence is
laid out over the shards by these quotas, so shards get disjoint blocks, and each shard is ordered by a hash of its own.

Null texts and texts without words have size 0 and take 0. A null source is a source of its own, last in order. An empty
table gives an empty result. Documents with equal ids and equal sizes are ties; their order is fixed by the text's hash, and
rows that repeat are one block's neighbours. Long texts are counted whole. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from targetry.llm.common import TOKEN_PATTERN, store

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Documents in a block, about; the number of blocks of a source follows from it.
BLOCK_DOCS = 512
#: Shards of the output: a power of two, since the tree halves.
SHARDS = 16
SEED = 20_250_101


def _unit(*parts: Column | str) -> Column:
    """A fixed pseudo-random number in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, source_docs, target. sizes: source, size (long), one row per document.

    Water filling: sources are passed by growing cap/weight; those whose share would exceed the cap keep the cap, the
    others divide what is left by weight. This is what resharing an excess until none is left comes to. The windows
    here have one row per source.
    """
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * float(most)).withColumn("need", F.col("cap") / F.col("w"))
    by_need = W.orderBy("need", F.col("source").asc_nulls_last())
    whole = by_need.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open_w", F.sum("w").over(by_need.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    # the first source that can take its share fixes the level for all after it
    level = F.first(F.when(F.col("level") <= F.col("need"), F.col("level")), ignorenulls=True).over(whole)
    t = t.withColumn("level", level)
    return t.select("source", "source_size", "source_docs", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def hypergeometric(good: Column, everything: Column, draws: Column, u: Column) -> Column:
    """Inverse of the hypergeometric distribution at u: how many of draws out of everything are among good (longs).

    The probabilities are built from the mode outwards by the ratio of neighbours, so no factorial is needed; beyond
    twelve standard deviations they are too small to change a double.
    """

    g, n, d = (x.cast("double") for x in (good, everything, draws))

    def ratio(k: Column) -> Column:  # p(k + 1) / p(k)
        k = k.cast("double")
        return (g - k) * (d - k) / ((k + 1) * (n - g - d + k + 1))

    low, high = F.greatest(F.lit(0.0), d + g - n), F.least(d, g)
    mode = F.greatest(low, F.least(high, F.floor((d + 1) * (g + 1) / (n + 2)).cast("double")))
    spread = F.ceil(F.sqrt(d * (g / n) * (1 - g / n) + 1) * 12 + 12)
    first, last, mode = F.greatest(low, mode - spread).cast("long"), F.least(high, mode + spread).cast("long"), mode.cast("long")
    none = F.array().cast("array<bigint>")
    above = F.when(last > mode, F.sequence(mode, last - 1)).otherwise(none)
    below = F.when(first < mode, F.sequence(mode - 1, first, F.lit(-1).cast("long"))).otherwise(none)
    pair = lambda p, s: F.struct(p.alias("p"), s.alias("s"))
    none_yet = pair(F.lit(1.0), F.lit(0.0))
    up = F.aggregate(above, none_yet, lambda a, k: pair(a["p"] * ratio(k), a["s"] + a["p"] * ratio(k)))
    down = F.aggregate(below, none_yet, lambda a, k: pair(a["p"] / ratio(k), a["s"] + a["p"] / ratio(k)))
    # from the smallest outcome up, until the sum reaches u's part of the whole
    state = lambda p, s, k, want: F.struct(p.alias("p"), s.alias("s"), k.alias("k"), want.alias("want"))
    walk = F.aggregate(
        F.sequence(first, last),
        state(down["p"], F.lit(0.0), first - 1, u * (up["s"] + down["s"] + 1)),
        lambda a, k: F.when(a["s"] >= a["want"], a).otherwise(state(F.when(k < last, a["p"] * ratio(k)).otherwise(a["p"]), a["s"] + a["p"], k, a["want"])),
    )
    drawn = walk["k"]
    zero = F.lit(0).cast("long")
    return F.when((draws <= 0) | (good <= 0), zero).when(draws >= everything, good.cast("long")).when(good >= everything, draws.cast("long")).otherwise(drawn)


def _drawn(left: Column, room: Column, took: Column) -> Column:
    return F.struct(left.alias("left"), room.alias("room"), took.alias("took"))


def _draw(width: int) -> Callable[[Column, Column], Column]:
    """One source's draw for the left child of a node of width shards."""

    def step(a: Column, x: Column) -> Column:
        got = hypergeometric(x["q"], a["left"], a["room"], _unit(F.col("shard"), F.lit(width), x["key"]))
        return _let(got, lambda g: _drawn(a["left"] - x["q"], a["room"] - g, F.concat(a["took"], F.array(g))))

    return step


def split_tree(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, shard, from_j, n: each shard's part of a source's block sequence. quotas: source, q (blocks to place).

    Level by level a node's blocks are halved; the sources draw in turn from the room that the left child still has,
    which is the multivariate hypergeometric distribution. A node's sources are one array, so there is a row per node.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards has to be a power of two")
    entry = F.struct(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~")).alias("key"), F.col("source"), F.col("q").cast("long").alias("q"))
    node = quotas.where("q > 0").groupBy().agg(F.array_sort(F.collect_list(entry)).alias("have")).select(F.lit(0).alias("shard"), "have")
    zero, half = F.lit(0).cast("long"), shards
    while half > 1:
        width, half = half, half // 2
        node = node.withColumn("all", F.aggregate("have", zero, lambda a, x: a + x["q"]))
        odd = F.when((F.col("all") % 2 == 1) & (_unit("shard", F.lit(width)) < 0.5), F.lit(1).cast("long")).otherwise(zero)
        start = _drawn(F.col("all"), F.floor(F.col("all") / 2) + odd, F.array().cast("array<bigint>"))
        draw = _draw(width)
        node = node.withColumn("took", F.aggregate("have", start, draw)["took"])
        give = lambda left: F.transform("have", lambda x, i: F.struct(x["key"].alias("key"), x["source"].alias("source"), (F.col("took")[i] if left else x["q"] - F.col("took")[i]).alias("q"))).alias("have")
        children = F.array(F.struct(F.col("shard"), give(True)), F.struct((F.col("shard") + half).alias("shard"), give(False)))
        node = node.select(F.explode(children).alias("n")).select("n.*")
    out = node.select("shard", F.explode("have").alias("x")).select("shard", F.col("x.source").alias("source"), F.col("x.q").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("from_j", F.coalesce(before, zero)).where("n > 0").select("source", "shard", "from_j", "n")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_REPEATS,
    shards: int = SHARDS,
    block_docs: int = BLOCK_DOCS,
    carry: tuple[str, ...] = (),
    prefix: str = "",
) -> DataFrame:
    """key, size, source_size, target, placements and the columns of carry; one row per document.

    prefix goes before the names of the four; columns of carry that have one of these names are replaced.

    placements: array of struct(shard, copy, position, words), one entry for each time the document is taken; words is
    its size, or less for the one document of a source in which the last pass ends. The words of a source's entries add
    up to its target, rounded. Within a shard, documents are ordered by position.
    """
    carry = tuple(c for c in carry if c not in [f"{prefix}{n}" for n in ("size", "source_size", "target", "placements")])
    rows = docs.select(
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), F.col(key).cast("string"), F.when(F.col(key).isNull(), F.col(text))).alias("_h"),
        F.xxhash64(text).alias("_t"),
        F.col(key).alias("_key"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    narrow = store(rows.select("source", "size", "_h", "_t", "_key"))
    if not carry:  # nothing else of the documents is wanted
        rows = narrow
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_docs") / float(block_docs)))
    words = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    sums = store(
        targets(narrow.select("source", "size"), weights, most)
        .withColumn("blocks", blocks)
        .withColumn("passes", passes)
        .withColumn("rest", words - F.col("passes") * F.col("source_size"))
        .withColumnRenamed("source", "_s")
    )
    same = F.col("source").eqNullSafe(F.col("_s"))
    deal = lambda df: df.join(sums, same).withColumn("block", F.pmod(F.shiftrightunsigned("_h", 7), F.col("blocks")))
    dealt = deal(rows)
    # what each block holds, in the source's permuted order of blocks, and where the last pass ends
    in_order = W.partitionBy("_s").orderBy(F.xxhash64(F.lit(SEED + 1), "_s", "block"), "block")
    held = (
        deal(narrow).groupBy("_s", "block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("blocks", "passes", "rest")])
        .withColumn("p", F.row_number().over(in_order).cast("long") - 1)
        .withColumn("n_held", F.count("*").over(W.partitionBy("_s")))
        .withColumn("before", F.coalesce(F.sum("words").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    )
    held = store(held.withColumn("last", F.col("before") < F.col("rest")).withColumn("cut", F.when(F.col("last") & (F.col("before") + F.col("words") > F.col("rest")), F.col("rest") - F.col("before"))))
    quotas = held.groupBy(F.col("_s").alias("source")).agg((F.sum("passes") + F.sum(F.col("last").cast("long"))).alias("q"))
    ranges = split_tree(quotas, shards).groupBy(F.col("source").alias("_r")).agg(F.array_sort(F.collect_list(F.struct("from_j", "n", "shard"))).alias("ranges"))
    shard_of = lambda j: F.filter("ranges", lambda r: (r["from_j"] <= j) & (j < r["from_j"] + r["n"]))[0]["shard"]
    copies = F.when(F.col("passes") + F.col("last").cast("long") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") + F.col("last").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    placed = held.join(ranges, F.col("_s").eqNullSafe(F.col("_r")), "left").select(
        F.col("_s").alias("_b"),
        F.col("block").alias("_block"),
        "cut",
        F.transform(copies, lambda e: F.struct(shard_of(e * F.col("n_held") + F.col("p")).alias("shard"), e.alias("copy"))).alias("copies"),
    )
    placed = store(placed)
    inside = W.partitionBy("_s", "block").orderBy("_h", "_key", "size", "_t").rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(placed, F.col("_s").eqNullSafe(F.col("_b")) & (F.col("block") == F.col("_block")))
    out = out.withColumn("_before", F.when(F.col("cut").isNotNull(), F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))))
    in_cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("cut") - F.col("_before")))
    taken = lambda c: F.when(F.col("cut").isNotNull() & (c["copy"] == F.col("passes")), in_cut).otherwise(F.col("size"))
    entry = lambda c: F.struct(c["shard"].alias("shard"), c["copy"].alias("copy"), F.xxhash64(F.lit(SEED + 2), "_key", "_t", c["copy"]).alias("position"), taken(c).alias("words"))
    placements = F.filter(F.transform("copies", entry), lambda x: x["words"] > 0)
    # no aliases here: one of a carried column's name would take the place of the column of that name in the expressions
    own = ("size", "source_size", "target")
    out = out.select("_key", *[f"_carry_{c}" for c in carry], *own, placements.alias("_placements"))
    return out.toDF(key, *carry, *[f"{prefix}{c}" for c in (*own, "placements")])
