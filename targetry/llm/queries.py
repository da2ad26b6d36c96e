"""The operators over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from targetry.llm import decontam, embedding_dedup, jaccard, language_id, licenses, lm_score, mixing, nearest, pii, prefix_trie, quality, runs, url_filter
from targetry.llm.common import TOKEN_PATTERN, table

URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("placements").cast("long").alias("n_copies"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.remainder(F.col("doc_id"), 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return lm_score.score(docs, ~F.col("held_out"), carry=("doc_id", "held_out"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "expected_grade", "p_top", "keep")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.start")).alias("first_word"),
        F.array_max(F.col("base.start")).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("base.label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.col("base.label"), F.col("found.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("found.confidence")), F.lit(0.0))).alias("score"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = decontam.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tenth document by the checksum of its id the words from one on are made periodic first."""
    sum_ = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (sum_ % 10 == 0).alias("made"), F.floor(sum_ / 10).cast("long").alias("g"))
    words = F.when(F.col("made"), F.regexp_extract_all("text", F.lit(f"({TOKEN_PATTERN})"), F.lit(1)))
    docs = docs.withColumn("w", words).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.when(F.col("made") & (F.col("n") > 0), F.array_join(F.transform("w", word), " ")).otherwise(F.col("text"))
    found = runs.find(docs.select("doc_id", text.alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns of each conversation are those of the first of its five, as many as the checksum of its id says."""
    own = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    five = F.col("conv_id") - F.col("conv_id") % 5
    heads = own.where(F.col("conv_id") == five).select(F.col("conv_id").alias("five"), F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    none = F.slice("turns", 1, 0)
    made = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return prefix_trie.trie(own.withColumn("five", five).join(heads, "five", "left").select("conv_id", made.alias("turns")))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)
    return found.select(F.col("query").alias("query_id"), "rank", "vec_id", F.col("distance").alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{r.verdict}', '{r.host}', '{r.path}')" for i, r in enumerate(URL_RULES))}) AS t(i, v, h, q))
SELECT page_id, host, path,
  (SELECT arg_min(h || q, -length(h || q) * 100 + i) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
  coalesce((SELECT arg_min(v, -length(h || q) * 100 + i) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)), 'allow') AS verdict
FROM p
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM ip),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
h AS (SELECT doc_id, p, dw.k AS k, item FROM (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM dp) AS dw JOIN g ON dw.k = g.k AND dw.g = g.g),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.95),
r AS (SELECT a AS o, a AS n FROM l UNION SELECT r.o, l.b FROM r JOIN l ON r.n = l.a),
c AS (SELECT o, min(n) AS least FROM r GROUP BY o),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, coalesce(least, e.vec_id) AS component_id, coalesce(least, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = o LEFT JOIN d ON e.vec_id = d.a
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS held FROM s x JOIN s y ON x.g = y.g AND x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * held >= 75 * (x.n + y.n - held)),
r AS (SELECT a AS o, a AS n FROM l UNION SELECT r.o, l.b FROM r JOIN l ON r.n = l.a),
c AS (SELECT o, min(n) AS least FROM r GROUP BY o)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = o
"""

#: The unsigned CRC-32 of an expression's ASCII digits, bit by bit; 3988292384 is the reversed polynomial.
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
  lambda c, z: list_reduce(list_prepend(xor(c, z), [CAST(0 AS BIGINT) FOR y IN range(8)]), lambda u, y: CASE WHEN u & 1 = 1 THEN xor(u >> 1, CAST(3988292384 AS BIGINT)) ELSE u >> 1 END)), CAST(4294967295 AS BIGINT))"""

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, {_CRC32.format('doc_id')} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
c AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM b),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE w END AS w FROM c),
x AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM t),
e AS (SELECT u.doc_id, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.word = v.word AND u.i < v.i),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.s <= s.s AND o.s + o.m >= s.s + s.m)),
f AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, m := m, q := q), (-m, s, q)) AS best, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.s + r.q AND x.i < r.s + r.m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.m AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.m // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, c - c % 5 AS b, {_CRC32.format('c')} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT o.c, pos, role, text FROM o JOIN t ON t.c = b WHERE pos <= h UNION ALL SELECT o.c, pos, role, text FROM o JOIN t ON t.c = o.c WHERE pos > h),
s AS (SELECT o.c, coalesce(list(struct_pack(role := role, text := text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS w FROM o LEFT JOIN r ON r.c = o.c GROUP BY o.c),
p AS (SELECT c, len(w) AS n, unnest(range(len(w) + 1)) AS d, w FROM s),
m AS (SELECT c, n, d, md5(CAST(list_slice(w, 1, d) AS VARCHAR) || d) AS k, CASE WHEN d > 0 THEN md5(CAST(list_slice(w, 1, d - 1) AS VARCHAR) || (d - 1)) END AS above, CASE WHEN d > 0 THEN strlen(w[d].text) ELSE 0 END AS size FROM p),
v AS (SELECT k, d, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved, sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM m GROUP BY k, d),
x AS (SELECT v.*, (SELECT count(*) FROM v u WHERE u.above = v.k) AS n_children FROM v),
i AS (SELECT DISTINCT a.k AS top, b.k AS k FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d),
z AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM i JOIN x ON x.k = i.k GROUP BY top)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN z ON z.top = x.k LEFT JOIN v u ON u.k = x.above
"""

OP13_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda s, x: s + x)) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op7_decontamination": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_nearest_neighbours": OP13_SQL}
