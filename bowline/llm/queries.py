"""The queries over the given tables: op key -> (spark, sf_dir) -> DataFrame, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bowline.llm import (convtrie, decontam, fingerprint, importance, langid, linededup, packing, pii, secretscan,
                         simhash, tokencount, toxicity, warc)
from bowline.llm.tables import ROW, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def put(f):
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f
    return put


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT digest, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1),
r AS (SELECT p.*, CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
      FROM p LEFT JOIN k ON k.digest = p.digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""


@query("op1_warc", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_packages(warc.revisits(pages))
    return warc.pages_of(warc.read_packages(manifest, with_payload=False)).drop("path", "offset", "length")


@query("op2_secret_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secretscan.scan(docs, secretscan.train(secretscan.labelled(docs)))
    base = F.concat(*secretscan.KINDS)
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in secretscan.KINDS],
        F.sha2(secretscan.joined(base), 256).alias("base_sha256"),
        secretscan.joined(F.concat(base, secretscan.ADDED)).alias("spans"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op4_document_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rest = langid.remainder("doc_id", 5)
    learn = F.coalesce(rest, F.lit(1)) != 0
    scored = toxicity.score(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"),
                            learn & (F.coalesce(rest, F.lit(1)) != 4), learn & (rest == 4))
    return scored.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, use=langid.learnable())
    return langid.identify(docs.select("doc_id", "text"), model).select(
        f"{ROW}.doc_id", (~langid.learnable(f"{ROW}.doc_id")).alias("held_out"), "lang_pred", "score")


# byte-wise word class of the contract, as DuckDB's RE2 sees it over code points
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
         unnest([list_aggregate(w[i:i + least(13, len(w)) - 1], 'string_agg', ' ')
                 FOR i IN range(1, greatest(len(w) - 13, 0) + 2)]) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT g.doc_id, g.p, g.n, win.item_id FROM
    (SELECT doc_id, n, p, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS gram FROM grams) g
  JOIN win ON win.n = g.n AND win.win = g.gram),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM
         (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM
         (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


@query("op8_benchmark_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))
    return out.select(f"{ROW}.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      "items_sha256", "contaminated")


OP9_SQL = f"""
WITH t AS (SELECT doc_id, source, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT r, doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t),
y AS (SELECT *, trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS k FROM x),
f AS (SELECT source, k, count(DISTINCT r) AS n FROM y WHERE k <> '' GROUP BY source, k),
h AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT f.source, f.k FROM f JOIN h ON h.source IS NOT DISTINCT FROM f.source
        WHERE n >= {linededup.MIN_PAGES} AND n > CAST({linededup.RATIO} AS DOUBLE) * pages),
z AS (SELECT y.*, bad.k IS NOT NULL AS dropped FROM y
      LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM y.source AND bad.k = y.k),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS kept
      FROM z GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256
FROM t LEFT JOIN g ON g.r = t.r
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_lines(docs).select(
        f"{ROW}.doc_id", "n_lines", "n_dropped", F.length("kept_text").cast("long").alias("kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > tokencount.LIMIT)


@query("op11_pii")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.BASE),
        F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


# CRC-32 in SQL: the byte table from its rule, then a fold over the bytes of a string
CRC_TABLE = """crc_step(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS tab FROM crc_step WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes; ``tab`` of crc_table must be in scope."""
    byte = f"list_transform(range(1, strlen({text}) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))"
    fold = f"list_reduce({byte}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT))"
    return f"xor({fold}, 4294967295)"


OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
df AS (SELECT r, unnest(w) AS x FROM d),
bf AS (SELECT unnest({_WORDS}) AS x FROM benchmark WHERE text IS NOT NULL),
dist AS (SELECT DISTINCT x FROM (SELECT x FROM df UNION ALL SELECT x FROM bf)),
xb AS (SELECT x, {crc32_sql('x')} % {importance.BUCKETS} AS bucket FROM dist, crc_table),
s AS (SELECT bucket, count(*) AS s FROM df JOIN xb USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN xb USING (x) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM df) AS sn, (SELECT count(*) FROM bf) AS tn),
g AS (
  SELECT b.bucket, CAST(floor(1000 * ln(
           (CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(sn + {importance.BUCKETS} AS DOUBLE))
           / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(tn + {importance.BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
  FROM range({importance.BUCKETS}) b(bucket) CROSS JOIN totals LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
per AS (SELECT r, sum(gain) AS total FROM df JOIN xb USING (x) JOIN g USING (bucket) GROUP BY r),
w AS (
  SELECT d.r, doc_id, CAST(len(d.w) AS BIGINT) AS n_features,
         CASE WHEN len(d.w) > 0 THEN CAST(total - ((total % len(d.w)) + len(d.w)) % len(d.w) AS BIGINT) // len(d.w) ELSE 0 END AS weight
  FROM d LEFT JOIN per USING (r)),
sc AS (
  SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
           / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM w),
may AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, weight, n_features) AS place,
         count(*) OVER () AS n
  FROM sc WHERE n_features >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN place <= {importance.PERCENT} * n // 100 THEN place END AS rank
FROM sc LEFT JOIN may USING (r)
"""


@query("op13_importance_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents").select("doc_id", "text"),
                               read(spark, sf_dir, "benchmark").select("text"))


OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
x AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, x, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) - 1 AS i FROM x),
n AS (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
h AS (SELECT c, n, {crc32_sql('s')} % {convtrie.SHARED} AS h,
             c - ((c % {convtrie.GROUP}) + {convtrie.GROUP}) % {convtrie.GROUP} AS b FROM n, crc_table),
v AS (SELECT h.*, least(h.h, coalesce(n.n, 0)) AS taken FROM h LEFT JOIN n ON n.c = h.b),
r AS (
  SELECT v.c, t.i + 1 AS depth, x, words FROM v JOIN t ON t.c = v.b AND t.i < v.h
  UNION ALL
  SELECT v.c, v.taken + t.i - v.h + 1, x, words FROM v JOIN t ON t.c = v.c AND t.i >= v.h),
q AS (
  SELECT v.c, coalesce(list(x ORDER BY depth) FILTER (x IS NOT NULL), []) AS xs,
         coalesce(list(words ORDER BY depth) FILTER (x IS NOT NULL), []) AS ws FROM v LEFT JOIN r ON r.c = v.c GROUP BY v.c),
d AS (SELECT c, xs, ws, unnest(range(0, len(xs) + 1)) AS depth FROM q),
p AS (SELECT c, depth, array_to_string(xs[1:depth], '') AS key, array_to_string(xs[1:depth - 1], '') AS parent,
             CASE WHEN depth = 0 THEN 0 ELSE ws[depth] END AS words, depth = len(xs) AS ends FROM d),
g AS (
  SELECT key, depth, min(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY key, depth),
k AS (SELECT parent AS key, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY parent),
u AS (
  SELECT a.key, sum((b.n_convs - 1) * b.words) AS saved, count(*) FILTER (k.key IS NULL) AS n_leaves
  FROM g a JOIN g b ON b.depth >= a.depth AND starts_with(b.key, a.key) LEFT JOIN k ON k.key = b.key GROUP BY a.key)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, CASE WHEN g.depth > 0 THEN up.conv_id END AS parent_conv_id, g.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN u ON u.key = g.key LEFT JOIN k ON k.key = g.key
LEFT JOIN g up ON g.depth > 0 AND up.key = g.parent AND up.depth = g.depth - 1
"""


@query("op12_conversation_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.conversation_trie(read(spark, sf_dir, "conversations")).drop("key", "parent")
