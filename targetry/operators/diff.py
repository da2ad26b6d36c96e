"""Diff of two revisions: what changed, what changed on its own account, and how far each change is from such a seed.

A revision is a DataFrame: name, hash, rule_type, deps array<string>, attributes map<string,string> (further columns
are carried along in the before and after structs). Names are unique in a revision. Hash `""` is a value, null hashes
count as `""`. Dependencies may name targets that don't exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from targetry.operators.phases import Phases
from targetry.sources import graphs
from targetry.sources.tables import bucketed, counted, store

NEW, DELETED, CHANGED = "CHANGE_TYPE_NEW", "CHANGE_TYPE_DELETED", "CHANGE_TYPE_CHANGED"
SOURCE_FILE = "source file"
#: Changed names and edges are broadcast up to so many bytes and rows, as counted when they were stored.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 400_000
#: Edges that a bucket has.
BUCKET_EDGES = 1 << 20

#: A table, or a stored graph.
Revision = DataFrame | graphs.Graph


def _session(revision: Revision) -> SparkSession:
    return revision.spark if isinstance(revision, graphs.Graph) else revision.sparkSession


def _strings() -> Column:
    return F.array().cast("array<string>")


def narrow(before: DataFrame, after: DataFrame) -> DataFrame:
    """name and change type of what changed: the join reads names and hashes alone."""
    b = before.select("name", F.coalesce("hash", F.lit("")).alias("b_hash"))
    a = after.select("name", F.coalesce("hash", F.lit("")).alias("a_hash"))
    kind = F.when(F.col("b_hash").isNull(), NEW).when(F.col("a_hash").isNull(), DELETED).when(F.col("b_hash") != F.col("a_hash"), CHANGED)
    return b.join(a, "name", "full_outer").select("name", kind.alias("change_type")).where("change_type IS NOT NULL")


def edges(targets: DataFrame) -> DataFrame:
    """src (dependent), dst (dependency), ord."""
    return targets.select(F.col("name").alias("src"), F.posexplode("deps").alias("ord", "dst")).where("dst <> ''").select("src", "dst", "ord")


def deps_changed(before: Column, after: Column) -> Column:
    """Lengths differ, or something of before is not in after (so [a, a] to [a, b] is no change)."""
    before, after = F.coalesce(before, _strings()), F.coalesce(after, _strings())
    return (F.size(before) != F.size(after)) | (F.size(F.array_except(before, after)) > 0)


def attributes_changed(before: Column, after: Column, allowed: list[str] | None = None) -> Column:
    """allowed: the only names that count; None: all."""

    def entries(m: Column) -> Column:
        m = F.coalesce(m, F.create_map().cast("map<string,string>"))
        if allowed is not None:
            m = F.map_filter(m, lambda k, _: k.isin(allowed))
        return F.array_sort(F.map_entries(m))

    return entries(before) != entries(after)


def _wide(df: DataFrame, alias: str) -> DataFrame:
    return df.select("name", F.struct(*df.columns).alias(alias))


def _narrow_first(before: DataFrame, after: DataFrame, phases: Phases) -> DataFrame:
    """Rows of what changed: names and hashes are joined first. Few changed names are then sent to the wide rows, so that only
    rows of theirs are shuffled."""
    with phases.phase("hash_diff"):
        changed, facts = counted(narrow(before, after), size=F.sum(F.octet_length("name")))
    few = facts["n"] <= BROADCAST_ROWS and (facts["size"] or 0) <= BROADCAST_BYTES
    own = lambda df: df.join(F.broadcast(changed.select("name")), "name", "left_semi") if few else df
    return changed.join(own(_wide(before, "before")), "name", "left").join(own(_wide(after, "after")), "name", "left")


def _at_once(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same, by one join of the wide rows."""
    hash_ = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.col(f"{c}.hash"), F.lit("")))
    both = _wide(before, "before").join(_wide(after, "after"), "name", "full_outer").where(~hash_("before").eqNullSafe(hash_("after")))
    kind = F.when(F.col("before").isNull(), NEW).when(F.col("after").isNull(), DELETED).otherwise(CHANGED)
    return both.select("name", kind.alias("change_type"), "before", "after")


def _changed(before: Revision, after: Revision, allowed: list[str] | None, phases: Phases) -> tuple[DataFrame, dict]:
    """Rows of what changed, stored: name, change_type, before, after (structs, null where there is none), dep_set_changed,
    attrs_changed, is_source; and facts about them. Of stored graphs groups whose digests differ are read, at once if these
    are few or all; if some are left out but most are not, changes are few for the rows."""
    share = 0.9
    with phases.phase("align"):
        if isinstance(before, graphs.Graph):
            before, after, share = graphs.pruned(before, after)
    rows = _at_once(before, after) if share == 1 or share <= graphs.MOST_PRUNED else _narrow_first(before, after, phases)
    both, no = F.col("change_type") == CHANGED, F.lit(False)
    with phases.phase("rows"):
        rows = rows.select(
            "name", "change_type", "before", "after",
            (both & deps_changed(F.col("before.deps"), F.col("after.deps"))).alias("dep_set_changed"),
            (both & attributes_changed(F.col("before.attributes"), F.col("after.attributes"), allowed)).alias("attrs_changed"),
            F.coalesce(F.col("after.rule_type") == SOURCE_FILE, no).alias("is_source"),
        )
        out, facts = counted(rows, size=F.sum(F.octet_length("name")), deps=F.sum(F.size(F.coalesce("after.deps", _strings()))))
        phases.add("rows", changed=facts["n"])
    return out, facts


def _links(rows: DataFrame, facts: dict, phases: Phases) -> tuple[DataFrame | None, int]:
    """src, dst, is_changed, is_source: dependencies of changed targets on NEW or CHANGED ones in the after revision, repeats
    once, stored; and their number. None if there are none. Flags and distances ask for no others."""
    if not facts["deps"]:
        return None, 0
    with phases.phase("reverse"):
        there = rows.where(F.col("change_type") != DELETED)
        kinds = there.select(F.col("name").alias("dst"), (F.col("change_type") == CHANGED).alias("is_changed"), "is_source")
        few = facts["n"] <= BROADCAST_ROWS and facts["size"] <= BROADCAST_BYTES
        own = there.select(F.col("name").alias("src"), F.explode(F.array_distinct("after.deps")).alias("dst")).where("dst <> ''")
        links, seen = counted(own.join(F.broadcast(kinds) if few else kinds, "dst").select("src", "dst", "is_changed", "is_source"))
        phases.add("reverse", links=seen["n"])
    return (links, seen["n"]) if seen["n"] else (None, 0)


def _judged(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """name, the flags of a change and is_seed."""
    both, no = F.col("change_type") == CHANGED, F.lit(False)
    if links is None:
        out = rows.withColumns({"dep_changed": no, "source_dep_changed": no})
    else:
        flags = links.groupBy(F.col("src").alias("name")).agg(F.max("is_changed").alias("dep_changed"), F.max(links["is_source"]).alias("source_dep_changed"))
        out = rows.join(flags, "name", "left").withColumns({c: both & F.coalesce(c, no) for c in ("dep_changed", "source_dep_changed")})
    seed = ~both | F.col("is_source") | ~F.col("dep_changed") | F.col("dep_set_changed") | F.col("source_dep_changed") | F.col("attrs_changed")
    return out.select("name", "dep_changed", "source_dep_changed", "dep_set_changed", "attrs_changed", seed.alias("is_seed"))


def _judged_whole(rows: DataFrame) -> DataFrame:
    """name, change_type, before, after, is_seed where no changed target depends on another: without a join."""
    judged = _judged(rows.withColumn("name", F.struct("name", "change_type", "before", "after")), None)
    return judged.select("name.*", "is_seed")


def classify(before: Revision, after: Revision, allowed: list[str] | None = None) -> DataFrame:
    """name, change_type, before, after (structs, null where there is none), dep_changed, source_dep_changed,
    dep_set_changed, attrs_changed, is_seed."""
    phases = Phases(_session(before))
    rows, facts = _changed(before, after, allowed, phases)
    judged = _judged(rows, _links(rows, facts, phases)[0])
    return rows.select("name", "change_type", "before", "after").join(judged, "name")


def distances(changed: DataFrame, links: DataFrame, max_distance: int = -1, n_links: int | None = None, phases: Phases | None = None) -> DataFrame:
    """name, distance: seeds 0, else the fewest steps over dependents of the after revision, entering changed targets
    only; -1 where none leads there, or none of at most max_distance steps.

    changed: name, is_seed. links: src, dst among changed targets. Only links of others than seeds are walked; many are
    stored in buckets of dst, so that a level shuffles its frontier and never the links. Each level is stored.
    """
    phases = phases or Phases(changed.sparkSession)
    with phases.phase("bfs"):
        waiting = changed.where("NOT is_seed").select("name")
        known = changed.select("name", F.when(F.col("is_seed"), 0).otherwise(-1).alias("distance"))
        if n_links == 0 or waiting.isEmpty():
            return known
        near = links.join(waiting.select(F.col("name").alias("src")), "src", "left_semi").select("src", "dst").distinct()
        if n_links is None or n_links > BUCKET_EDGES // 4:
            near = bucketed(near, "dst", max(changed.sparkSession.sparkContext.defaultParallelism, -(-(n_links or 0) // BUCKET_EDGES)))
        else:
            near = store(near)
        frontier, level, reached = changed.where("is_seed").select("name"), 0, []
        while max_distance < 0 or level < max_distance:
            level += 1
            step = near.join(frontier.select(F.col("name").alias("dst")), "dst").select(F.col("src").alias("name")).distinct()
            for r in reached:
                step = step.join(r.select("name"), "name", "left_anti")
            frontier, facts = counted(step)
            phases.add("bfs", reached=facts["n"], levels=int(facts["n"] > 0))
            if not facts["n"]:
                break
            reached.append(frontier.select("name", F.lit(level).alias("distance")))
        out = known.where("distance = 0")
        for r in reached:
            out = out.union(r)
        return known.select("name").join(out, "name", "left").select("name", F.coalesce("distance", F.lit(-1)).alias("distance"))


def within(changed: DataFrame, max_distance: int) -> DataFrame:
    """Negative: all rows, also unreached ones; else those at most so far."""
    return changed if max_distance < 0 else changed.where(F.col("distance").between(0, max_distance))


def diff(before: Revision, after: Revision, max_distance: int = -1, allowed: list[str] | None = None, phases: Phases | None = None) -> DataFrame:
    """name, change_type, before, after, is_seed, distance; by name. Of stored graphs only groups whose digests differ are
    read. phases gets times and counts."""
    phases = phases or Phases(_session(before))
    rows, facts = _changed(before, after, allowed, phases)
    links, n_links = _links(rows, facts, phases)
    kept = rows.select("name", "change_type", "before", "after")
    if links is None:  # nothing that changed depends on another change
        return _judged_whole(rows).withColumn("distance", F.when(F.col("is_seed"), 0).otherwise(-1)).orderBy("name")
    with phases.phase("seed"):
        seeds, facts = counted(_judged(rows, links).select("name", "is_seed"), seeds=F.count_if("is_seed"))
        phases.add("seed", seeds=facts["seeds"])
    reach = distances(seeds, links, max_distance, n_links, phases)
    # seeds are those at no distance
    return kept.join(reach, "name").select("name", "change_type", "before", "after", (F.col("distance") == 0).alias("is_seed"), "distance").orderBy("name")


def all_targets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every target of either revision at distance 0; those of both are CHANGED even if their hashes agree."""
    b, a = before.select("name", F.struct(*before.columns).alias("before")), after.select("name", F.struct(*after.columns).alias("after"))
    kind = F.when(F.col("before").isNull(), NEW).when(F.col("after").isNull(), DELETED).otherwise(CHANGED)
    return b.join(a, "name", "full_outer").select("name", kind.alias("change_type"), "before", "after", F.lit(True).alias("is_seed"), F.lit(0).alias("distance"))


def files_differ(before: DataFrame | None, after: DataFrame | None) -> bool:
    """Whether two revisions' files that call for all targets (path, hash) differ as maps: by a path that one lacks or whose
    hash isn't the same, nulls being equal. No table at all is an empty map; of repeated paths the greatest hash counts."""
    one = lambda df, c: df.groupBy("path").agg(F.max("hash").alias(c), F.lit(True).alias(f"{c}_there"))
    if before is None or after is None:
        rest = after if before is None else before
        return rest is not None and not rest.isEmpty()
    b, a = one(before, "b"), one(after, "a")
    both = b.join(a, b["path"].eqNullSafe(a["path"]), "full_outer")
    return not both.where(~(F.col("b_there").eqNullSafe(F.col("a_there")) & F.col("b").eqNullSafe(F.col("a")))).isEmpty()


def diff_or_all(before: Revision, after: Revision, before_files: DataFrame | None, after_files: DataFrame | None, max_distance: int = -1, allowed: list[str] | None = None, phases: Phases | None = None) -> DataFrame:
    """diff(), or all_targets() if the files that call for it differ: these small tables are compared first, and the graphs are
    then read for one of the two alone."""
    if files_differ(before_files, after_files):
        whole = lambda r: r.rows() if isinstance(r, graphs.Graph) else r
        return all_targets(whole(before), whole(after)).select("name", "change_type", "before", "after", "is_seed", "distance").orderBy("name")
    return diff(before, after, max_distance, allowed, phases)


def equivalent(one: DataFrame, other: DataFrame) -> bool:
    """Equal rows, whatever the order of dependencies and tags."""

    def plain(df: DataFrame) -> DataFrame:
        sorted_ = [F.to_json(F.array_sort(c)).alias(c) if t.startswith("array") else F.to_json(F.array_sort(F.map_entries(c))).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
        return df.select(*sorted_)

    a, b = plain(one), plain(other)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def allowed_attributes(attributes: Column, allowed: list[str] | None) -> Column:
    return attributes if allowed is None else F.map_filter(attributes, lambda k, _: k.isin(allowed))
