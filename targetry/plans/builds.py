"""Registered queries of graph building, its sources and the responses, and their SQL.

Raw targets are derived from the graph of the fixtures: rules with tags and attributes, source files with locations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from targetry.functions import canonical, sizes
from targetry.operators import build, chunks, diff, merkle, responses
from targetry.plans import fixtures
from targetry.plans.registry import query
from targetry.sources import parsers, wire
from targetry.sources.tables import store

RULES = ("nation", "customer", "supplier", "order")


def raw_targets(spark, sf_dir: str) -> DataFrame:
    n = fixtures.described(spark, sf_dir)
    kind, k, text = F.col("kind"), F.col("k").cast("string"), lambda x: F.lit(x).cast("string")
    own = lambda c: F.col(c).alias(c)
    attribute = lambda name, type_, **more: F.from_json(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(type_).alias("type"), *[v.alias(c) for c, v in more.items()])), canonical.ATTRIBUTE_TYPE)
    attributes = F.array(attribute("tags", "STRING_LIST", string_list=F.array(F.concat(text("t"), F.substring(k, -1, 1)), text("all"))), attribute("tier", "STRING", string_value=own("tier")), attribute("n", "INTEGER", int_value=(F.col("k") % 1000).cast("int")))
    rule = kind.isin(*RULES)
    doubled = F.array(F.concat(F.lit("//"), kind, F.lit("/"), k, F.lit(":"), kind, F.lit("/"), k, F.lit("/x")))
    inputs = F.when(rule, F.concat("deps", doubled))
    parts = {
        "kind": F.when(rule, "RULE").otherwise("SOURCE_FILE"), "name": F.col("name"), "rule_class": F.when(rule, F.col("rule_type")),
        "location": F.when(~rule, F.concat(F.lit("/w/"), kind, F.lit("/"), F.substring_index("name", ":", -1), F.lit("_"), k, F.lit(":1:1"))), "rule_input": inputs,
        "rule_output": F.array().cast("array<string>"), "default_setting": F.array().cast("array<string>"), "skylark_env_hash": F.when(rule, F.col("own")), "generating_rule": text(None),
        "visibility": F.when(rule, None).when(F.col("k") % 4 == 0, F.array(text("//visibility:private"), text("//a:v"))).otherwise(F.array(text("//visibility:private"))), "attributes": F.when(rule, attributes),
    }
    return n.select(*[c.alias(name) for name, c in parts.items()])


def file_hashes(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """known: two thirds of the parts and all lines; contents: all parts."""
    nodes, *_ = fixtures.nodes_and_edges(spark, sf_dir)
    place = F.concat(F.col("kind"), F.lit("/"), F.substring_index("name", ":", -1), F.lit("_"), F.col("k").cast("string"))
    files = nodes.where(F.col("kind").isin("part", "line"))
    known = files.where("kind = 'line' OR k % 3 > 0").select(place.alias("path"), F.sha1("own").alias("hash"))
    return known, files.where("kind = 'part'").select(F.concat(F.lit("/w/"), place).alias("path"), F.sha1(F.concat(F.lit("c"), "own")).alias("hash"))


def _sql(body: str, more: str = "", recursive: bool = False) -> str:
    plain = {t: t for t in fixtures.TABLES}
    return f"WITH {'RECURSIVE ' if recursive else ''}n AS MATERIALIZED ({fixtures.NODES.format(**plain)}), e AS MATERIALIZED ({fixtures.EDGES.format(**plain)}){', ' + more if more else ''} {body}"


_PLACE = "kind || '/' || split_part(name, ':', 2) || '_' || k"
_IS_RULE = f"kind IN ({', '.join(repr(k) for k in RULES)})"
_SOURCES = f"""CASE WHEN kind IN ('part', 'line') AND k % 4 <> 0 AND (kind = 'line' OR k % 3 > 0) THEN sha1(own)
  WHEN kind = 'part' THEN sha1(unhex(hex(name) || sha1('c' || own) || CASE WHEN k % 4 = 0 THEN hex('//a:v') ELSE '' END)) ELSE sha1(name) END"""


def _uv(x: str) -> str:
    """Base 128 of a number below 2**21, in SQL."""
    return f"CASE WHEN {x} < 128 THEN printf('%02X', {x}) WHEN {x} < 16384 THEN printf('%02X%02X', {x} % 128 + 128, {x} // 128) ELSE printf('%02X%02X%02X', {x} % 128 + 128, {x} // 128 % 128 + 128, {x} // 16384) END"


def _head(name: str, kind: int, there: bool = True) -> str:
    return (canonical.varint(len(name)) + name.encode() + bytes([kind, there])).hex().upper()


def _text(name: str, x: str) -> str:
    """A string field of an expression that is never null."""
    return f"'{_head(name, canonical.STRING)}' || {_uv(f'strlen({x})')} || hex({x})"


def _framed(x: str) -> str:
    return f"{_uv(f'(length({x}) // 2)')} || {x}"


def _constant(name: str, kind: int, payload: bytes | None) -> str:
    return "'" + _head(name, kind, payload is not None) + ("" if payload is None else (canonical.varint(len(payload)) + payload).hex().upper()) + "'"


def _attribute(name: str, type_: str, **given: str) -> str:
    """An attribute's message in SQL; given: field to hexadecimal SQL of framed payload."""
    out = ["'" + (canonical.varint(12) + b"message_type" + bytes([canonical.STRING, 1, 9]) + b"Attribute").hex().upper() + "'"]
    fixed = {"name": name.encode(), "type": canonical.ATTRIBUTE_KINDS[type_].to_bytes(4, "big")}
    for field, kind, many, _ in canonical.FIELDS["Attribute"]:
        number = canonical.LIST if many else canonical.KINDS[kind]
        if field in given:
            out.append(f"'{_head(field, number)}' || {given[field]}")
        elif many:
            out.append(_constant(field, number, bytes([canonical.KINDS.get(kind, canonical.MESSAGE), 0])))
        else:
            out.append(_constant(field, number, fixed.get(field)))
    return " || ".join(out)


def _list(items: str, element: int) -> str:
    """Body of a list field over a SQL list of hexadecimal elements."""
    each = f"array_to_string(list_transform({items}, lambda x: '01' || {_framed('x')}), '')"
    return f"'{element:02X}' || {_uv(f'len({items})')} || {each}"


def rule_sql(rows: str) -> str:
    """CTEs that end with rule_hash(name, h): rows is a query of name, class, env, tier, n, tag and deps (sorted list, with
    the doubled label), where tier may be empty but not null."""
    tag_list = _list("list_sort([hex(tag), hex('all')])", canonical.STRING)
    return f"""rr AS ({rows}),
ra AS (SELECT *, {_attribute('n', 'INTEGER', int_value="'04' || printf('%08X', n)")} AS a1, {tag_list} AS tl, {_attribute('tier', 'STRING', string_value=_framed('hex(tier)'))} AS a3 FROM rr),
rb AS (SELECT *, {_attribute('tags', 'STRING_LIST', string_list_value=_framed('tl'))} AS a2 FROM ra),
rc AS (SELECT *, {_list('[a1, a2, a3]', canonical.MESSAGE)} AS attrs, {_list('list_sort(list_transform(deps, lambda d: hex(d)))', canonical.STRING)} AS ins FROM rb),
rd AS (SELECT name, '{(canonical.varint(12) + b"message_type" + bytes([canonical.STRING, 1, 4]) + b"Rule").hex().upper()}' || {_text('name', 'name')} || {_text('rule_class', 'class')} || '{_head('attribute', canonical.LIST)}' || {_framed('attrs')}
  || '{_head('rule_input', canonical.LIST)}' || {_framed('ins')} || {_constant('rule_output', canonical.LIST, bytes([canonical.STRING, 0]))} || {_constant('default_setting', canonical.LIST, bytes([canonical.STRING, 0]))} || {_text('skylark_environment_hash_code', 'env')} AS m FROM rc),
rule_hash AS MATERIALIZED (SELECT name, sha1(unhex('{_head('rule', canonical.MESSAGE)}' || {_framed('m')})) AS h FROM rd)"""


_RULE_ROWS = f"""SELECT n.name, n.rule_type AS class, n.own AS env, n.tier, n.k % 1000 AS n, 't' || right(CAST(n.k AS VARCHAR), 1) AS tag,
  list_concat(coalesce(d.deps, []), ['//' || n.kind || '/' || n.k || ':' || n.kind || '/' || n.k || '/x']) AS deps
  FROM n LEFT JOIN (SELECT src, list(dst) AS deps FROM e GROUP BY src) d ON d.src = n.name WHERE n.{_IS_RULE}"""


_CONVERTED = _sql(f"""SELECT n.name, n.rule_type, coalesce(d.deps, '') AS deps, CASE WHEN {_IS_RULE} THEN 't' || right(CAST(k AS VARCHAR), 1) || ',all' ELSE '' END AS tags,
 CASE WHEN {_IS_RULE} THEN 'tier=' || tier ELSE '' END AS attributes, false AS external FROM n LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS deps FROM e GROUP BY src) d ON d.src = n.name""")


@query(_CONVERTED)
def raw_conversion(spark, sf_dir):
    """Raw targets as targets: inputs sorted and without doubled labels, tags, string attributes."""
    return _shown(build.convert(raw_targets(spark, sf_dir)))


@query(_CONVERTED)
def decoded_records(spark, sf_dir):
    """The same from record files: raw targets in the wire format, a thousand packages of a kind to a file, read again."""
    rows = raw_targets(spark, sf_dir)
    place = F.concat(F.regexp_extract("name", "^//([^/]*)/", 1), F.lit("/"), F.floor(F.regexp_extract("name", "/([0-9]+):", 1).cast("long") / 1000))
    pieces = rows.select(place.alias("path"), "name", F.hex(wire.record()).alias("piece"))
    files = pieces.groupBy("path").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "piece"))), lambda x: x["piece"]), "")).alias("content"))
    return _shown(build.convert(wire.raw(wire.targets(parsers.records(files)))))


def _shown(t: DataFrame) -> DataFrame:
    shown = F.array_join(F.transform(F.map_entries("attributes"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return t.select("name", "rule_type", F.array_join("deps", ",").alias("deps"), F.array_join("tags", ",").alias("tags"), shown.alias("attributes"), "external")


@query(_sql("SELECT name, h AS hash FROM rule_hash", rule_sql(_RULE_ROWS)))
def canonical_rule_hash(spark, sf_dir):
    """SHA-1 of each rule's canonical encoding."""
    return build.convert(raw_targets(spark, sf_dir)).where("own IS NOT NULL").select("name", F.lower(F.hex("own")).alias("hash"))


@query(_sql(f"SELECT name, {_SOURCES} AS hash FROM n WHERE kind IN ('region', 'part', 'line')"))
def source_hashes(spark, sf_dir):
    """Known hashes, or name, content and visibility."""
    sources = build.convert(raw_targets(spark, sf_dir)).where("rule_type = 'source file'")
    return build.source_hash(sources, *file_hashes(spark, sf_dir), root="/w")


def _fold(p: str, below: str, kinds: str) -> str:
    return f"{p} AS MATERIALIZED (SELECT * FROM {below} UNION ALL SELECT r.name, sha1(unhex(r.h || coalesce(string_agg(b.hash, '' ORDER BY e.dst), ''))) FROM rule_hash r JOIN n ON n.name = r.name AND n.kind IN ({kinds}) LEFT JOIN e ON e.src = r.name LEFT JOIN {below} b ON b.name = e.dst GROUP BY r.name, r.h)"


_BUILT = rule_sql(_RULE_ROWS) + f""", b0 AS MATERIALIZED (SELECT name, {_SOURCES} AS hash FROM n WHERE kind IN ('region', 'part', 'line')), {_fold('b1', 'b0', "'nation'")}, {_fold('b2', 'b1', "'customer', 'supplier'")}, {_fold('b3', 'b2', "'order'")}"""


@query(_sql(f"SELECT n.name, b3.hash, coalesce(r.h, '') AS hash_without_deps, n.rule_type, {_IS_RULE} AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst = n.name) AS root FROM n JOIN b3 ON b3.name = n.name LEFT JOIN rule_hash r ON r.name = n.name", _BUILT))
def built_graph(spark, sf_dir):
    """Raw targets to a hashed graph."""
    known, contents = file_hashes(spark, sf_dir)
    return build.build(raw_targets(spark, sf_dir), known, contents, root="/w").select("name", "hash", "hash_without_deps", "rule_type", "root")


@query(_sql("SELECT name, CAST(CASE kind WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 WHEN 'supplier' THEN 2 WHEN 'order' THEN 3 ELSE 0 END AS INTEGER) AS level FROM n"))
def topological_levels(spark, sf_dir):
    return merkle.topological_order(fixtures.graph(spark, sf_dir))


# --- listings, markers, directories ---

_LISTED = "SELECT o_custkey % 50 AS g, o_orderkey AS k, md5(CAST(o_orderkey AS STRING)) AS h, concat('d ', o_custkey % 50, '/', o_orderkey % 900) AS path FROM {orders}"


@query(f"SELECT path, arg_max(h, k) AS hash FROM ({_LISTED.format(orders='orders').replace('STRING', 'VARCHAR')}) WHERE k % 10 <> 3 GROUP BY path")
def listing_hashes(spark, sf_dir):
    """File hashes of version control's listings, one for each of 50 folders; of repeated paths the last counts, broken records don't."""
    rows = spark.sql(_LISTED, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    record = F.concat(F.lit("100644 blob "), F.when(F.col("k") % 10 == 3, F.lit("zz")).otherwise(F.upper("h")), F.lit("\t"), F.col("path"), F.lit("\x00"))
    listing = rows.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", record.alias("r")))), lambda x: x["r"]), "").alias("content"))
    return parsers.file_hashes(listing)


_STATUS = "SELECT o_custkey % 20 AS g, o_orderkey AS k, element_at(array('M', 'A', 'D', 'R087', 'C100'), CAST(o_orderkey % 5 + 1 AS INT)) AS status FROM {orders}"


@query("SELECT o_custkey % 20 AS g, CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, substring('MADRC', CAST(o_orderkey % 5 + 1 AS INTEGER), 1) AS status, CASE WHEN o_orderkey % 5 > 2 THEN 'new/' ELSE '' END || o_orderkey AS path FROM orders")
def name_status(spark, sf_dir):
    """Changed files of NUL-separated diffs; renames and copies have two paths."""
    rows = spark.sql(_STATUS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    k = F.col("k").cast("string")
    field = F.when(F.col("k") % 5 > 2, F.concat_ws("\x00", "status", F.concat(F.lit("old/"), k), F.concat(F.lit("new/"), k))).otherwise(F.concat_ws("\x00", "status", k))
    return parsers.name_status(rows.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", field.alias("f")))), lambda x: x["f"]), "\x00").alias("content")))


@query("SELECT 'r' || c_custkey || '+' AS repo, sha1('head' || c_custkey || 'FILE:@@//' || c_name) AS marker FROM customer WHERE c_custkey % 7 > 0")
def marker_hashes(spark, sf_dir):
    """Markers of repositories: the first line and the lines of local inputs; empty files are passed over."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit(" \n\n")).otherwise(F.concat(F.lit("\n head"), k, F.lit("\nENV:HOME /x\nFILE:@@//"), F.col("c_name"), F.lit("\nFILE:@@other//p q\n")))
    return parsers.markers(c.select(F.concat(F.lit("/base/external/@r"), k, F.lit("+.marker")).alias("path"), text.alias("content")))


@query("SELECT doc_id, sha1(unhex(hex('blob ' || strlen(coalesce(text, ''))) || '00' || hex(coalesce(text, '')))) AS hash FROM documents")
def blob_hashes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", parsers.blob_hash(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("hash"))


@query("""SELECT directory, sha1(unhex(string_agg(b, '' ORDER BY p))) AS hash FROM (
 SELECT directory, p, CASE WHEN kind = 0 THEN '00' || printf('%016X', strlen(n)) || hex(n) WHEN kind = 1 THEN '01' || printf('%016X', strlen(n)) || hex(n) || md5(n) ELSE '02' || printf('%016X', strlen(n)) || hex(n) || printf('%016X', strlen('../' || n)) || hex('../' || n) END AS b FROM (
  SELECT o_custkey % 40 AS directory, ['a', CAST(o_orderkey AS VARCHAR)] AS p, CAST(o_orderkey AS VARCHAR) AS n, 1 + o_orderkey % 2 AS kind FROM orders UNION ALL SELECT DISTINCT o_custkey % 40, ['a'], 'a', 0 FROM orders)) GROUP BY directory""")
def directory_hashes(spark, sf_dir):
    """Trees of files and links, each in a folder."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.col("o_orderkey").cast("string")
    directory = (F.col("o_custkey") % 40).alias("directory")
    inside = o.select(directory, F.concat(F.lit("a/"), name).alias("path"), F.when(F.col("o_orderkey") % 2 == 0, "file").otherwise("symlink").alias("kind"), F.md5(name).alias("hash"), F.concat(F.lit("../"), name).alias("link"))
    top = o.select(directory, F.lit("a").alias("path"), F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("link")).distinct()
    return parsers.directory_hashes(inside.union(top))


# --- responses ---


def _changed(spark, sf_dir):
    before, after = fixtures.pair(spark, sf_dir)
    none, no = F.array().cast("array<string>"), F.lit(False)
    wide = lambda df: df.withColumns({"tags": F.when(F.col("rule_type").like("%_binary"), F.array(F.lit("all"), F.substring("name", -2, 2))).otherwise(none), "root": no, "external": no})
    return store(diff.diff(wide(before), wide(after)))


_ROWS = """t AS (SELECT name, rule_type FROM tb WHERE name IN (SELECT name FROM c) UNION SELECT name, rule_type FROM ta WHERE name IN (SELECT name FROM c)),
nm AS (SELECT name FROM t UNION SELECT e.dst FROM e WHERE e.src IN (SELECT name FROM c) UNION SELECT f.dst FROM f WHERE f.src IN (SELECT name FROM c))"""


def response_ids(spark, sf_dir):
    """The names that changed targets mention, in one space of ids, and how often the rows use each."""
    rows, dicts = responses.changed_to_ids(_changed(spark, sf_dir))
    both = rows.select("before").where("before IS NOT NULL").union(rows.select("after").where("after IS NOT NULL")).toDF("t")
    used = both.select(F.explode(F.concat(F.array("t.id"), "t.deps")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return dicts["targets"].join(used, "id").select("name", "id", "n")


def output_filter(spark, sf_dir):
    """Rows by what is left of their targets once hashes and tags are stripped."""
    rows, _ = responses.changed_to_ids(_changed(spark, sf_dir))
    rows = rows.select("change_type", responses.stripped(F.col("after"), attributes=True).alias("t"))
    return rows.groupBy("change_type").agg(F.count("*").alias("n"), F.count_if(F.col("t.hash") == "").alias("bare"), F.sum(F.size("t.deps")).cast("long").alias("deps"), F.sum(F.size("t.tags")).cast("long").alias("tags"), F.sum(F.size("t.attributes")).cast("long").alias("attributes"))


def register_responses(sql, diff_sql: str) -> None:
    """sql and diff_sql are the catalogue's, which has the hashes of both revisions in SQL."""
    ids = "SELECT d.name, CAST(d.id AS INTEGER) AS id, count(*) AS n FROM (SELECT name, row_number() OVER (ORDER BY name) AS id FROM nm) d JOIN u ON u.name = d.name GROUP BY 1, 2"
    sides = "u AS (SELECT name FROM tb WHERE name IN (SELECT name FROM c) UNION ALL SELECT name FROM ta WHERE name IN (SELECT name FROM c) UNION ALL SELECT e.dst FROM e WHERE e.src IN (SELECT name FROM c) UNION ALL SELECT f.dst FROM f WHERE f.src IN (SELECT name FROM c))"
    query(sql(ids, f"{diff_sql}, {_ROWS}, {sides}"))(response_ids)
    query(sql("""SELECT c.change_type, count(*) AS n, CAST(count(*) FILTER (ta.name IS NOT NULL) AS BIGINT) AS bare, CAST(sum(CASE WHEN ta.name IS NOT NULL THEN (SELECT count(*) FROM f WHERE f.src = c.name) END) AS BIGINT) AS deps,
 CAST(CASE WHEN count(ta.name) > 0 THEN 0 END AS BIGINT) AS tags, CAST(sum(CASE WHEN ta.name IS NOT NULL THEN CASE WHEN ta.tier = '' THEN 0 ELSE 1 END END) AS BIGINT) AS attributes FROM c LEFT JOIN ta ON ta.name = c.name GROUP BY c.change_type""", diff_sql))(output_filter)


_CHUNKED = """
v AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS deps FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, CAST(list_sum(list_transform(deps, lambda x: CASE WHEN x < 128 THEN 1 WHEN x < 16384 THEN 2 WHEN x < 2097152 THEN 3 ELSE 4 END)) AS BIGINT) AS d FROM v),
z AS (SELECT l_orderkey, CASE WHEN l_orderkey = 0 THEN 0 WHEN l_orderkey < 128 THEN 2 WHEN l_orderkey < 16384 THEN 3 WHEN l_orderkey < 2097152 THEN 4 ELSE 5 END + 1 + CASE WHEN d < 128 THEN 1 ELSE 2 END + d AS b FROM s),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l_orderkey) AS i, b, CAST(sum(b) OVER (ORDER BY l_orderkey) AS BIGINT) AS t FROM z),
h AS (SELECT CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, (SELECT max(i) FROM p WHERE t <= 65536) AS j
 UNION ALL SELECT c + 1, j, (SELECT t FROM p WHERE p.i = h.j), (SELECT max(p.i) FROM p WHERE p.t <= 65536 + (SELECT t FROM p WHERE p.i = h.j)) FROM h WHERE j < (SELECT max(i) FROM p))"""


@query(f"WITH RECURSIVE {_CHUNKED} SELECT c AS chunk_no, j - i AS n_rows, (SELECT t FROM p WHERE p.i = h.j) - t AS n_bytes FROM h")
def greedy_chunks(spark, sf_dir):
    """Orders by key in response chunks of at most 64 kB."""
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("deps"))
    size = sizes.number_field(F.col("l_orderkey")) + sizes.packed_field(F.col("deps"))
    rows = v.select("l_orderkey", size.cast("long").alias("n_bytes"))
    cut = chunks.numbered(rows, "n_bytes", 65_536, "l_orderkey")
    return cut.groupBy("chunk_no").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
