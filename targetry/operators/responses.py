"""Responses: graphs and changes in one space of dense ids, with their dictionaries, stripped and cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from targetry.functions import sizes
from targetry.operators import chunks, dictionaries
from targetry.sources.tables import store

#: The five dictionaries.
NAMES = ("targets", "rule_types", "tags", "attribute_names", "attribute_values")
_PLAIN = ("name", "hash", "rule_type", "deps", "tags", "root", "external", "attributes")


def make_dictionaries(targets: DataFrame) -> dict[str, DataFrame]:
    """name, id for each of NAMES, over all that targets (rows of a graph) mention."""
    pairs = targets.select(F.explode("attributes").alias("k", "v"))
    words = {
        "targets": targets.select("name").union(targets.select(F.explode("deps"))),
        "rule_types": targets.select(F.col("rule_type").alias("name")),
        "tags": targets.select(F.explode("tags").alias("name")),
        "attribute_names": pairs.select(F.col("k").alias("name")),
        "attribute_values": pairs.select(F.col("v").alias("name")),
    }
    return {k: store(dictionaries.dense_ids(words[k].where("name IS NOT NULL"))) for k in NAMES}


def to_ids(targets: DataFrame, dicts: dict[str, DataFrame]) -> DataFrame:
    """key columns of targets other than a graph's, and target: struct(id, hash, deps, rule_type, tags, root, external,
    attributes) in ids. Lists keep their order."""
    keys = [c for c in targets.columns if c not in _PLAIN]
    rows = store(targets.withColumn("_row", F.monotonically_increasing_id()))

    def listed(column: str, words: DataFrame) -> DataFrame:
        each = rows.select("_row", F.posexplode(column).alias("ord", "name")).join(words, "name")
        return each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias(f"_{column}"))

    pairs = rows.select("_row", F.explode("attributes").alias("k", "v"))
    pairs = pairs.join(dicts["attribute_names"].select(F.col("name").alias("k"), F.col("id").alias("ki")), "k").join(dicts["attribute_values"].select(F.col("name").alias("v"), F.col("id").alias("vi")), "v")
    maps = pairs.groupBy("_row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ki", "vi")))).alias("_attributes"))
    out = rows.join(dicts["targets"], "name").join(dicts["rule_types"].select(F.col("name").alias("rule_type"), F.col("id").alias("_type")), "rule_type", "left")
    out = out.join(listed("deps", dicts["targets"]), "_row", "left").join(listed("tags", dicts["tags"]), "_row", "left").join(maps, "_row", "left")
    ids = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    target = F.struct("id", "hash", ids("_deps").alias("deps"), F.coalesce("_type", F.lit(0)).alias("rule_type"), ids("_tags").alias("tags"), "root", "external", F.coalesce("_attributes", F.create_map().cast("map<int,int>")).alias("attributes"))
    return out.select(*keys, target.alias("target"))


def changed_to_ids(changed: DataFrame, allowed: list[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(change_type, before, after, distance) in ids, both sides in one space, and the dictionaries. allowed: the only
    attributes that are kept."""
    kept = lambda side: F.col(f"{side}.attributes") if allowed is None else F.map_filter(F.col(f"{side}.attributes"), lambda k, _: k.isin(allowed))
    sides = [changed.where(F.col(s).isNotNull()).select(F.lit(s).alias("side"), F.col("name").alias("of"), *[(kept(s) if c == "attributes" else F.col(f"{s}.{c}")).alias(c) for c in _PLAIN]) for s in ("before", "after")]
    both = store(sides[0].union(sides[1]))
    dicts = make_dictionaries(both)
    mapped = store(to_ids(both, dicts))
    side = lambda s: mapped.where(F.col("side") == s).select(F.col("of").alias("name"), F.col("target").alias(f"{s}_ids"))
    out = changed.select("name", "change_type", "distance").join(side("before"), "name", "left").join(side("after"), "name", "left")
    return out.select("change_type", F.col("before_ids").alias("before"), F.col("after_ids").alias("after"), "distance"), dicts


def stripped(target: Column, hashes: bool = False, tags: bool = False, attributes: bool = False) -> Column:
    """A target struct without what isn't asked for."""
    out = target
    if not hashes:
        out = out.withField("hash", F.lit(""))
    if not tags:
        out = out.withField("tags", F.array().cast("array<int>"))
    if not attributes:
        out = out.withField("attributes", F.create_map().cast("map<int,int>"))
    return F.when(target.isNotNull(), out)


def needed_dictionaries(dicts: dict[str, DataFrame], tags: bool = False, attributes: bool = False) -> dict[str, DataFrame]:
    """Without the dictionaries of stripped columns."""
    gone = (() if tags else ("tags",)) + (() if attributes else ("attribute_names", "attribute_values"))
    return {k: v for k, v in dicts.items() if k not in gone}


def metadata_chunks(dicts: dict[str, DataFrame], most: int) -> DataFrame:
    """message, dictionary, id, name: names of targets and values of attributes in messages of at most most bytes (an entry
    that is larger is alone); the small dictionaries go with the first message."""
    big = [("targets", 0), ("attribute_values", 1)]
    out, shift = None, F.lit(0).cast("long")
    first = [k for k in dicts if k not in ("targets", "attribute_values")]
    for name, _ in big:
        if name not in dicts or dicts[name].isEmpty():
            continue
        rows = dicts[name].select("id", "name", sizes.map_entry_size(F.col("id"), F.octet_length("name")).alias("bytes"))
        cut = store(chunks.numbered(rows, "bytes", most, "id"))
        part = cut.select((F.col("chunk_no") + shift).alias("message"), F.lit(name).alias("dictionary"), "id", "name")
        out = part if out is None else out.union(part)
        shift = shift + F.lit(cut.agg(F.max("chunk_no")).first()[0] + 1)
    for name in first:
        part = dicts[name].select(F.lit(0).cast("long").alias("message"), F.lit(name).alias("dictionary"), "id", "name")
        out = part if out is None else out.union(part)
    return out
