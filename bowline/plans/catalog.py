"""The query catalog: every registered operator as (Spark query, oracle SQL).

Each Spark query takes (spark, sf_dir) and reads the driver's tables whole.
Computed columns carry the same names in both forms; floating results are
rounded to 6 digits on both sides; vectors are returned in long form
(id, dim, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bowline.config import DEFAULT_LIMITS, Limits, ModelConfig
from bowline.functions import text as T
from bowline.plans import oracle as O
from bowline.session import materialize, table
from bowline.sources.corpus import corpus, spread

# Model used by the catalog: the reference demo program's settings.
QCFG = ModelConfig(embedding_dim=256, min_token_frequency=3, max_vocabulary_size=10000,
                   random_seed=42, use_ngrams=True, use_orthogonal_init=True)
DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = positive_zero(sql)
        return fn
    return deco


def positive_zero(sql: str) -> str:
    """Add 0.0 to every ``round(..., DIGITS)`` of an oracle query.

    DuckDB rounds tiny negatives to -0.0 while Spark's round gives 0.0;
    -0.0 + 0.0 is +0.0, so both engines print the same value.
    """
    out, i, tail = [], 0, f", {DIGITS})"
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len("round("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = positive_zero(sql[j + len("round("):k - 1]) + ")"
        call = "round(" + inner
        out.append(sql[i:j])
        out.append(f"({call} + 0.0)" if call.endswith(tail) else call)
        i = k


def r6(c):
    return F.round(c, DIGITS)


# ---- shared inputs -------------------------------------------------------------

_MODELS: dict = {}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(corpus(table(spark, sf_dir, "documents")))


def model(spark: SparkSession, sf_dir: str, cfg: ModelConfig = QCFG):
    from bowline.operators.train import train
    key = (spark.sparkContext.applicationId, sf_dir, cfg)
    if key not in _MODELS:
        _MODELS[key] = train(docs(spark, sf_dir), cfg)
    return _MODELS[key]


def long_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(vec_col).alias("dim", "value")) \
        .select(id_col, F.col("dim").cast("int").alias("dim"), r6(F.col("value")).alias("value"))


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_(O.corpus_cte(), O.terms_ctes())
VOCAB = with_(O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG))
MODEL = with_(O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG), O.projection_cte(QCFG))


# ---- S1, T1-T6 -----------------------------------------------------------------------

@register("corpus_scan", with_(O.corpus_cte()) + "SELECT doc_id, text FROM corpus")
def q_corpus_scan(spark, sf):
    return docs(spark, sf)


@register("normalize_text", with_(O.corpus_cte()) +
          "SELECT doc_id, lower(nfc_normalize(text)) AS norm_text FROM corpus")
def q_normalize_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize(F.col("text")).alias("norm_text"))


@register("tokenize", BASE + """SELECT doc_id, CAST(generate_subscripts(tokens, 1) - 1 AS INTEGER) AS pos,
       unnest(tokens) AS token FROM tokens""")
def q_tokenize(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "token"))


def _ngram_sql(n: int) -> str:
    parts = " || '_' || ".join(f"tokens[i + {k}]" for k in range(n))
    return BASE + f"""SELECT doc_id, CAST(generate_subscripts(g, 1) - 1 AS INTEGER) AS pos, unnest(g) AS ngram
FROM (SELECT doc_id, CASE WHEN len(tokens) >= {n}
        THEN list_transform(range(1, len(tokens) - {n - 2}), lambda i: {parts}) ELSE [] END AS g
      FROM tokens)"""


def _ngram_query(n: int):
    def q(spark, sf):
        toks = T.tokenize(F.col("text"))
        return docs(spark, sf).select(
            "doc_id", F.posexplode(T.ngrams(toks, n)).alias("pos", "ngram"))
    return q


register("ngrams_2", _ngram_sql(2))(_ngram_query(2))
register("ngrams_3", _ngram_sql(3))(_ngram_query(3))


@register("document_terms", BASE + """SELECT doc_id, CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS pos,
       unnest(terms) AS term FROM terms""")
def q_document_terms(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.posexplode(T.process_text(F.col("text"))).alias("pos", "term"))


# ---- V1-V13 ---------------------------------------------------------------------------

def _stats(spark, sf):
    from bowline.operators.train import token_stats
    return token_stats(docs(spark, sf)).filter(F.col("token").isNotNull())


@register("token_frequency", BASE +
          "SELECT token, count(*) AS token_count FROM term_rows GROUP BY token")
def q_token_frequency(spark, sf):
    return _stats(spark, sf).select("token", "token_count")


@register("document_frequency", BASE +
          "SELECT token, count(DISTINCT doc_id) AS doc_freq FROM term_rows GROUP BY token")
def q_document_frequency(spark, sf):
    return _stats(spark, sf).select("token", "doc_freq")


@register("corpus_size", with_(O.corpus_cte()) + "SELECT count(*) AS n_docs FROM corpus")
def q_corpus_size(spark, sf):
    from bowline.operators.train import token_stats
    st = token_stats(docs(spark, sf))
    return st.filter(F.col("token").isNull()).select(F.col("doc_freq").alias("n_docs"))


@register("vocabulary", VOCAB + "SELECT idx, token, token_count, doc_freq FROM vocab")
def q_vocabulary(spark, sf):
    return model(spark, sf).vocabulary.select("idx", "token", "token_count", "doc_freq")


@register("vocabulary_pruned", VOCAB + "SELECT idx, token, token_count, doc_freq FROM vocab")
def q_vocabulary_pruned(spark, sf):
    """The vocabulary counted the way a large corpus is: buckets first, then only tokens that can get in."""
    from bowline.operators.train import frequent_stats, select_vocabulary
    stats = materialize(frequent_stats(docs(spark, sf), QCFG), "token-stats")
    n_docs = stats.filter(F.col("token").isNull()).first()["doc_freq"]
    return select_vocabulary(stats, n_docs, QCFG).select("idx", "token", "token_count", "doc_freq")


@register("idf", VOCAB + f"SELECT idx, token, round(idf, {DIGITS}) AS idf FROM vocab")
def q_idf(spark, sf):
    return model(spark, sf).vocabulary.select("idx", "token", r6(F.col("idf")).alias("idf"))


@register("vocabulary_size", VOCAB + "SELECT count(*) AS vocab_size FROM vocab")
def q_vocabulary_size(spark, sf):
    m = model(spark, sf)
    return m.vocabulary.agg(F.count(F.lit(1)).alias("vocab_size"))


@register("vocab_lookup", VOCAB + f"""SELECT t.doc_id, t.pos, t.token, v.idx,
       round(coalesce(v.idf, 0.0), {DIGITS}) AS idf
FROM (SELECT doc_id, CAST(generate_subscripts(tokens, 1) - 1 AS INTEGER) AS pos,
             unnest(tokens) AS token FROM tokens) t
LEFT JOIN vocab v ON v.token = t.token""")
def q_vocab_lookup(spark, sf):
    m = model(spark, sf)
    toks = docs(spark, sf).select(
        "doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("pos", "token"))
    from bowline.operators.embed import vocab_lookup
    return vocab_lookup(toks, m).select("doc_id", "pos", "token", "idx", r6(F.col("idf")).alias("idf"))


@register("train_vocab_summary", VOCAB + f"""SELECT (SELECT n FROM n_docs) AS n_docs,
       count(*) AS vocab_size, CAST(sum(token_count) AS BIGINT) AS vocab_tokens,
       round(min(idf), {DIGITS}) AS min_idf, round(max(idf), {DIGITS}) AS max_idf
FROM vocab""")
def q_train_vocab_summary(spark, sf):
    m = model(spark, sf)
    return m.vocabulary.agg(
        F.lit(m.n_docs).cast("long").alias("n_docs"),
        F.count(F.lit(1)).alias("vocab_size"),
        F.sum("token_count").alias("vocab_tokens"),
        r6(F.min("idf")).alias("min_idf"), r6(F.max("idf")).alias("max_idf"))


# ---- V11/V12, E1-E9 -------------------------------------------------------------------

UCFG = QCFG.replace(use_orthogonal_init=False)
EMB = with_(O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG), O.projection_cte(QCFG),
            O.embed_ctes(QCFG))


@register("projection_gaussian", MODEL + f"SELECT idx, dim, round(pval, {DIGITS}) AS value FROM proj")
def q_projection_gaussian(spark, sf):
    return long_vectors(model(spark, sf).projection, "idx", "vec")


@register("projection_uniform", with_(O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(UCFG),
                                      O.projection_cte(UCFG)) +
          f"SELECT idx, dim, round(pval, {DIGITS}) AS value FROM proj")
def q_projection_uniform(spark, sf):
    from bowline.operators.train import projection_rows
    m = model(spark, sf)
    return long_vectors(projection_rows(m.vocabulary.select("idx"), m.vocab_size, UCFG),
                        "idx", "vec")


@register("term_frequency", with_(O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG),
                                  O.weights_ctes(QCFG)) +
          "SELECT doc_id, idx, tf, n_terms FROM tfv")
def q_term_frequency(spark, sf):
    from bowline.operators.embed import term_frequency
    return term_frequency(docs(spark, sf), model(spark, sf)).select(
        "doc_id", "idx", F.col("tf").cast("long").alias("tf"),
        F.col("n_terms").cast("long").alias("n_terms"))


@register("bm25_weights", with_(O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG),
                                O.weights_ctes(QCFG)) +
          f"SELECT doc_id, idx, round(weight, {DIGITS}) AS weight FROM w")
def q_bm25_weights(spark, sf):
    from bowline.operators.embed import bm25_weights
    return bm25_weights(docs(spark, sf), model(spark, sf)).select(
        "doc_id", "idx", r6(F.col("weight")).alias("weight"))


@register("project_dense", EMB + f"SELECT doc_id, dim, round(value, {DIGITS}) AS value FROM dense")
def q_project_dense(spark, sf):
    from bowline.operators.embed import bm25_weights, project_sums
    m = model(spark, sf)
    return project_sums(bm25_weights(docs(spark, sf), m), m).select(
        "doc_id", F.col("dim").cast("int").alias("dim"), r6(F.col("value")).alias("value"))


@register("project_dropout", with_(O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG),
                                   O.projection_cte(QCFG), O.embed_ctes(QCFG, dropout=0.1)) +
          f"SELECT doc_id, dim, round(value, {DIGITS}) AS value FROM emb")
def q_project_dropout(spark, sf):
    from bowline.operators.embed import embed
    e = embed(docs(spark, sf), model(spark, sf), dropout_rate=0.1)
    return long_vectors(e, "doc_id", "embedding")


@register("embed_documents", EMB + f"SELECT doc_id, dim, round(value, {DIGITS}) AS value FROM emb")
def q_embed_documents(spark, sf):
    from bowline.operators.embed import embed
    return long_vectors(embed(docs(spark, sf), model(spark, sf)), "doc_id", "embedding")


@register("embed_documents_join", EMB + f"SELECT doc_id, dim, round(value, {DIGITS}) AS value FROM emb")
def q_embed_documents_join(spark, sf):
    """E6 / E7 for a model beyond the broadcast limit: the vocabulary in blocks."""
    from bowline.operators.embed import embed, model_bytes
    m = model(spark, sf)
    limits = Limits(broadcast_bytes=max(1, model_bytes(m) // 3))
    return long_vectors(embed(docs(spark, sf), m, limits=limits), "doc_id", "embedding")


@register("embedding_dim_check", EMB +
          "SELECT doc_id, CAST(count(*) AS INTEGER) AS dimension FROM emb GROUP BY doc_id")
def q_embedding_dim_check(spark, sf):
    from bowline.operators.embed import embed
    return embed(docs(spark, sf), model(spark, sf)).select(
        "doc_id", F.size("embedding").alias("dimension"))


# ---- X1-X7 on the embeddings table ----------------------------------------------------

def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def table_bytes(v: DataFrame) -> int:
    return v.agg(F.coalesce(F.sum(F.size("v") + 1), F.lit(0))).first()[0] * 8 + 1


def _next_pairs(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    a = v.select(F.col("vec_id").alias("a_id"), F.col("v").alias("va"))
    b = v.select(F.col("vec_id").alias("b_id"), F.col("v").alias("vb"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1)


VPAIRS = """vp AS (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, CAST(a.embedding AS DOUBLE[]) AS va,
         CAST(b.embedding AS DOUBLE[]) AS vb
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


@register("pair_cosine", with_(VPAIRS) +
          f"SELECT a_id, b_id, round({O.cos_sql('va', 'vb')}, {DIGITS}) AS similarity FROM vp")
def q_pair_cosine(spark, sf):
    from bowline.functions.vectors import cosine
    return _next_pairs(spark, sf).select("a_id", "b_id", r6(cosine(F.col("va"), F.col("vb"))).alias("similarity"))


@register("pair_distance", with_(VPAIRS) +
          f"SELECT a_id, b_id, round({O.dist_sql('va', 'vb')}, {DIGITS}) AS distance FROM vp")
def q_pair_distance(spark, sf):
    from bowline.functions.vectors import distance
    return _next_pairs(spark, sf).select("a_id", "b_id", r6(distance(F.col("va"), F.col("vb"))).alias("distance"))


def _pair_long_sql(expr: str) -> str:
    return with_(VPAIRS) + f"""SELECT a_id, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS dim,
       round(unnest(r), {DIGITS}) AS value
FROM (SELECT a_id, list_transform(list_zip(va, vb), lambda z: {expr}) AS r FROM vp)"""


@register("vector_subtract", _pair_long_sql("z[2] - z[1]"))
def q_vector_subtract(spark, sf):
    from bowline.functions.vectors import subtract
    return long_vectors(_next_pairs(spark, sf).select("a_id", subtract(F.col("vb"), F.col("va")).alias("r")), "a_id", "r")


@register("vector_add", _pair_long_sql("z[1] + z[2]"))
def q_vector_add(spark, sf):
    from bowline.functions.vectors import add
    return long_vectors(_next_pairs(spark, sf).select("a_id", add(F.col("va"), F.col("vb")).alias("r")), "a_id", "r")


VLONG = """vl AS (
  SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@register("vector_scale", with_(VLONG) + f"SELECT vec_id, dim, round(x * 0.5, {DIGITS}) AS value FROM vl")
def q_vector_scale(spark, sf):
    from bowline.functions.vectors import scale
    return long_vectors(vectors(spark, sf).select("vec_id", scale(F.col("v"), 0.5).alias("r")), "vec_id", "r")


@register("unit_normalize", with_(VLONG) + f"""SELECT vec_id, dim,
       round(CASE WHEN nrm > 1e-10 THEN x / nrm ELSE x END, {DIGITS}) AS value
FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS nrm FROM vl)""")
def q_unit_normalize(spark, sf):
    from bowline.functions.vectors import unit_normalize
    return long_vectors(vectors(spark, sf).select("vec_id", unit_normalize(F.col("v")).alias("r")), "vec_id", "r")


def _rank_sql(src: str, k: int) -> str:
    return f"""SELECT query_id, rank, cand_id, round(sim, {DIGITS}) AS similarity FROM (
  SELECT query_id, cand_id, sim, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY round(sim, 9) DESC, cand_id) AS INTEGER) AS rank
  FROM {src}) WHERE rank <= {k}"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select(F.col("query_id").cast("long").alias("query_id"), "rank",
                     F.col("cand_id").cast("long").alias("cand_id"),
                     r6(F.col("similarity")).alias("similarity"))


@register("topk_cosine", with_(
    """ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    f"""sims AS (SELECT q.vec_id AS query_id, c.vec_id AS cand_id, {O.cos_sql('q.v', 'c.v')} AS sim
             FROM ev q, ev c)""") + _rank_sql("sims", 5))
def q_topk_cosine(spark, sf):
    from bowline.operators.search import top_k_cosine
    v = vectors(spark, sf)
    return _ranked(top_k_cosine(v, v, 5, "vec_id", "v", "vec_id", "v"))


@register("topk_cosine_blocked", SQL["topk_cosine"])
def q_topk_cosine_blocked(spark, sf):
    from bowline.operators.search import top_k_cosine
    v = vectors(spark, sf)
    limits = Limits(broadcast_bytes=table_bytes(v) // 3)
    return _ranked(top_k_cosine(v, v, 5, "vec_id", "v", "vec_id", "v", limits=limits))


@register("topk_cosine_pruned", SQL["topk_cosine"])
def q_topk_cosine_pruned(spark, sf):
    """K1 over a pivot index: groups of candidates that cannot get in are skipped."""
    from bowline.operators.pivots import pivot_index, top_k
    v = vectors(spark, sf)
    return _ranked(top_k(v, pivot_index(v, c_id="vec_id", c_vec="v"), 5, "vec_id", "v")[0])


# ---- K2-K6 on texts ----------------------------------------------------------------------

def bench_items(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", "text")


QTEXT = [O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG), O.projection_cte(QCFG),
         O.embed_ctes(QCFG), "qsrc AS (SELECT item_id AS doc_id, text FROM benchmark)",
         O.terms_ctes("qsrc", prefix="q_"),
         O.embed_ctes(QCFG, ids="qsrc", prefix="q_", src_terms="q_terms", src_rows="q_term_rows"),
         O.embvec_cte("emb", "dv"), O.embvec_cte("q_emb", "qv")]


@register("nearest_neighbors", with_(*QTEXT, f"""sims AS (
  SELECT q.doc_id AS query_id, d.doc_id AS cand_id, {O.cos_sql('q.v', 'd.v')} AS sim
  FROM qv q, dv d)""") + _rank_sql("sims", 5))
def q_nearest_neighbors(spark, sf):
    from bowline.operators.search import nearest_neighbors
    return _ranked(nearest_neighbors(bench_items(spark, sf), docs(spark, sf), model(spark, sf), 5,
                                     q_id="item_id"))


def flagship(spark, sf):
    return q_nearest_neighbors(spark, sf)


@register("text_pair_similarity", with_(*QTEXT) + f"""SELECT a.doc_id AS a_id, b.doc_id AS b_id,
       round({O.cos_sql('a.v', 'b.v')}, {DIGITS}) AS similarity
FROM qv a JOIN qv b ON b.doc_id = a.doc_id + 1""")
def q_text_pair_similarity(spark, sf):
    from bowline.operators.coherence import text_pair_similarity
    return text_pair_similarity(_text_pairs(spark, sf), model(spark, sf)).select(
        F.col("pair_id").alias("a_id"), (F.col("pair_id") + 1).alias("b_id"), r6(F.col("similarity")).alias("similarity"))


def _text_pairs(spark, sf) -> DataFrame:
    """Neighbouring benchmark texts; those of an even first id count as related."""
    b = bench_items(spark, sf)
    nxt = b.select((F.col("item_id") - 1).alias("pair_id"), F.col("text").alias("word2"))
    return b.select(F.col("item_id").alias("pair_id"), F.col("text").alias("word1")).join(nxt, "pair_id").withColumn(
        "related", F.col("pair_id") % 2 == 0)


def _triples(spark, sf) -> DataFrame:
    b = bench_items(spark, sf)
    x = b.select(F.col("item_id").alias("analogy_id"), F.col("text").alias("a"))
    y = b.select(F.col("item_id").alias("iy"), F.col("text").alias("b"))
    z = b.select(F.col("item_id").alias("iz"), F.col("text").alias("c"))
    return (x.join(y, F.col("iy") == F.col("analogy_id") + 1)
            .join(z, F.col("iz") == F.col("analogy_id") + 2)
            .select("analogy_id", "a", "b", "c"))


@register("analogy", with_(*QTEXT, """tri AS (
  SELECT a.doc_id AS analogy_id, a.doc_id AS ia, b.doc_id AS ib, c.doc_id AS ic
  FROM qsrc a JOIN qsrc b ON b.doc_id = a.doc_id + 1 JOIN qsrc c ON c.doc_id = a.doc_id + 2)""",
    """tl AS (
  SELECT t.analogy_id, ea.dim, eb.value - ea.value + ec.value AS x
  FROM tri t JOIN q_emb ea ON ea.doc_id = t.ia JOIN q_emb eb ON eb.doc_id = t.ib AND eb.dim = ea.dim
  JOIN q_emb ec ON ec.doc_id = t.ic AND ec.dim = ea.dim)""",
    """tv AS (
  SELECT analogy_id, list(CASE WHEN nrm > 1e-10 THEN x / nrm ELSE x END ORDER BY dim) AS v
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY analogy_id)) AS nrm FROM tl)
  GROUP BY analogy_id)""",
    f"""sims AS (
  SELECT t.analogy_id AS query_id, d.doc_id AS cand_id, {O.cos_sql('t.v', 'd.v')} AS sim
  FROM tv t, dv d)""") + _rank_sql("sims", 3))
def q_analogy(spark, sf):
    from bowline.operators.search import analogy
    return _ranked(analogy(_triples(spark, sf), docs(spark, sf), model(spark, sf), 3))


@register("banded_pairs", with_(*QTEXT[:5], "dv AS (SELECT doc_id, list(value ORDER BY dim) AS v FROM emb GROUP BY doc_id)",
                                "pd AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos, v FROM dv)") +
          f"""SELECT a.pos AS a_pos, b.pos AS b_pos, round({O.cos_sql('a.v', 'b.v')}, {DIGITS}) AS similarity
FROM pd a JOIN pd b ON b.pos > a.pos AND b.pos <= a.pos + 4""")
def q_banded_pairs(spark, sf):
    from bowline.operators.positions import dense_positions
    from bowline.operators.search import banded_pairs
    items = dense_positions(docs(spark, sf), ["doc_id"])
    out = banded_pairs(items, model(spark, sf), 4)
    return out.select("a_pos", "b_pos", r6(F.col("similarity")).alias("similarity"))


@register("sample_texts", with_(O.corpus_cte()) + f"""SELECT doc_id, text FROM corpus
ORDER BY {O.draws.uniform_sql(O.draws.key_sql(42, 'sample', 'doc_id'))}, doc_id LIMIT 100""")
def q_sample_texts(spark, sf):
    from bowline.sources.corpus import sample
    return sample(docs(spark, sf), 100, 42).select("doc_id", "text")


# ---- D1-D9 retrieval ---------------------------------------------------------------------

RET_K = 10
QRELS_SQL = """qrels AS (
  SELECT DISTINCT b.item_id AS query_id, c.doc_id FROM benchmark b JOIN corpus c
  ON strpos(c.text, b.text) > 0)"""
RANKED_SQL = f"""sims AS (
  SELECT q.doc_id AS query_id, d.doc_id AS cand_id, {O.cos_sql('q.v', 'd.v')} AS sim
  FROM qv q, dv d)""", f"""rk AS (
  SELECT query_id, cand_id, sim, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY round(sim, 9) DESC, cand_id) AS INTEGER) AS rank
  FROM sims QUALIFY rank <= {RET_K})""", QRELS_SQL, """ranking AS (
  SELECT r.query_id, r.rank, r.cand_id AS doc_id, r.sim,
         CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS is_rel
  FROM rk r LEFT JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.cand_id)""", f"""perq AS (
  SELECT b.item_id AS query_id, CAST(coalesce(x.found, 0) AS BIGINT) AS found,
         coalesce(x.found, 0) / {float(RET_K)} AS precision,
         CASE WHEN coalesce(n.n_rel, 0) > 0 THEN coalesce(x.found, 0) / n.n_rel ELSE 0.0 END AS recall,
         CASE WHEN coalesce(x.found, 0) > 0 THEN x.ap_sum / x.found ELSE 0.0 END AS ap,
         coalesce(1.0 / x.first_hit, 0.0) AS rr
  FROM benchmark b
  LEFT JOIN (SELECT query_id, sum(is_rel) AS found,
                    sum(CASE WHEN is_rel = 1 THEN cum / rank END) AS ap_sum,
                    min(CASE WHEN is_rel = 1 THEN rank END) AS first_hit
             FROM (SELECT *, sum(is_rel) OVER (PARTITION BY query_id ORDER BY rank
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
                   FROM ranking) GROUP BY query_id) x ON x.query_id = b.item_id
  LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id) n
    ON n.query_id = b.item_id)"""


def _retrieval(spark, sf):
    from bowline.operators.retrieval import passage_qrels, retrieval_ranking
    d = docs(spark, sf)
    qrels = materialize(passage_qrels(bench_items(spark, sf), d), "qrels")
    ranking = retrieval_ranking(bench_items(spark, sf), qrels, d, model(spark, sf), RET_K,
                                q_id="item_id")
    return qrels, ranking


@register("passage_qrels", with_(O.corpus_cte(), QRELS_SQL) + "SELECT query_id, doc_id FROM qrels")
def q_passage_qrels(spark, sf):
    from bowline.operators.retrieval import passage_qrels
    return passage_qrels(bench_items(spark, sf), docs(spark, sf))


@register("retrieval_ranking", with_(*QTEXT, *RANKED_SQL[:4]) +
          f"SELECT query_id, rank, doc_id, round(sim, {DIGITS}) AS similarity, is_rel FROM ranking")
def q_retrieval_ranking(spark, sf):
    _, ranking = _retrieval(spark, sf)
    return ranking.select(F.col("query_id").cast("long").alias("query_id"), "rank",
                          F.col("doc_id").cast("long").alias("doc_id"),
                          r6(F.col("similarity")).alias("similarity"), "is_rel")


@register("retrieval_per_query", with_(*QTEXT, *RANKED_SQL) + f"""SELECT query_id, found,
       round(precision, {DIGITS}) AS precision, round(recall, {DIGITS}) AS recall,
       round(ap, {DIGITS}) AS ap, round(rr, {DIGITS}) AS rr FROM perq""")
def q_retrieval_per_query(spark, sf):
    from bowline.operators.retrieval import retrieval_per_query
    qrels, ranking = _retrieval(spark, sf)
    pq = retrieval_per_query(ranking, bench_items(spark, sf), qrels, RET_K, q_id="item_id")
    return pq.select("query_id", "found", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "ap", "rr")])


@register("retrieval_per_query_k0", """SELECT item_id AS query_id, CAST(0 AS BIGINT) AS found,
  CAST(0.0 AS DOUBLE) AS precision, CAST(0.0 AS DOUBLE) AS recall, CAST(0.0 AS DOUBLE) AS ap, CAST(0.0 AS DOUBLE) AS rr
FROM benchmark""")
def q_retrieval_per_query_k0(spark, sf):
    from bowline.operators.retrieval import passage_qrels, retrieval_per_query, retrieval_ranking
    b, d = bench_items(spark, sf), docs(spark, sf)
    qrels = passage_qrels(b, d)
    ranking = retrieval_ranking(b, qrels, d, model(spark, sf), 0, q_id="item_id")
    return retrieval_per_query(ranking, b, qrels, 0, q_id="item_id")


@register("retrieval_metrics", with_(*QTEXT, *RANKED_SQL) + f"""SELECT
  round(avg(precision), {DIGITS}) AS precision_at_k, round(avg(recall), {DIGITS}) AS recall_at_k,
  round(CASE WHEN avg(precision) + avg(recall) > 0
        THEN 2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)) ELSE 0.0 END, {DIGITS}) AS f1_score,
  round(avg(ap), {DIGITS}) AS mean_average_precision, round(avg(rr), {DIGITS}) AS mean_reciprocal_rank
FROM perq""")
def q_retrieval_metrics(spark, sf):
    from bowline.operators.retrieval import retrieval_metrics, retrieval_per_query
    qrels, ranking = _retrieval(spark, sf)
    m = retrieval_metrics(retrieval_per_query(ranking, bench_items(spark, sf), qrels, RET_K,
                                              q_id="item_id"))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


# ---- H1-H5 coherence on the embeddings table ---------------------------------------------

CPAIRS = """cp AS (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id, (a.label = b.label) AS related,
         CAST(a.embedding AS DOUBLE[]) AS va, CAST(b.embedding AS DOUBLE[]) AS vb
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
CSIMS = f"cs AS (SELECT a_id, b_id, related, {O.cos_sql('va', 'vb')} AS similarity FROM cp)"


def _coherence_pairs(spark, sf):
    from bowline.functions.vectors import cosine
    v = vectors(spark, sf)
    a = v.select(F.col("vec_id").alias("a_id"), F.col("v").alias("va"), F.col("label").alias("la"))
    b = v.select(F.col("vec_id").alias("b_id"), F.col("v").alias("vb"), F.col("label").alias("lb"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select(
        "a_id", "b_id", (F.col("la") == F.col("lb")).alias("related"),
        cosine(F.col("va"), F.col("vb")).alias("similarity"))


@register("coherence_pairs", with_(CPAIRS, CSIMS) +
          f"SELECT a_id, b_id, related, round(similarity, {DIGITS}) AS similarity FROM cs")
def q_coherence_pairs(spark, sf):
    p = _coherence_pairs(spark, sf)
    return p.select("a_id", "b_id", "related", r6(F.col("similarity")).alias("similarity"))


COHERENCE_SELECT = f"""SELECT
  round(coalesce(avg(CASE WHEN (similarity > 0.5) = related THEN 1.0 ELSE 0.0 END), 0.0), {DIGITS}) AS accuracy,
  round(coalesce(avg(CASE WHEN related THEN similarity END), 0.0), {DIGITS}) AS average_related_similarity,
  round(coalesce(avg(CASE WHEN NOT related THEN similarity END), 0.0), {DIGITS}) AS average_unrelated_similarity,
  round(coalesce(avg(CASE WHEN related THEN similarity END), 0.0)
        - coalesce(avg(CASE WHEN NOT related THEN similarity END), 0.0), {DIGITS}) AS contrast_score
FROM cs"""


@register("coherence_metrics", with_(CPAIRS, CSIMS) + COHERENCE_SELECT)
def q_coherence_metrics(spark, sf):
    from bowline.operators.coherence import coherence_metrics
    m = coherence_metrics(_coherence_pairs(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@register("text_coherence_metrics", with_(*QTEXT, f"""cs AS (
  SELECT a.doc_id % 2 = 0 AS related, {O.cos_sql('a.v', 'b.v')} AS similarity
  FROM qv a JOIN qv b ON b.doc_id = a.doc_id + 1)""") + COHERENCE_SELECT)
def q_text_coherence_metrics(spark, sf):
    from bowline.operators.coherence import evaluate_semantic_coherence
    m = evaluate_semantic_coherence(_text_pairs(spark, sf), model(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


# ---- O1-O6 temporal ordering and K5-K6 recall on conversations -------------------------

CONV = [O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG), O.projection_cte(QCFG),
        "csrc AS (SELECT conv_id * 100000 + turn AS doc_id, conv_id, turn, text FROM conversations)",
        O.terms_ctes("csrc", prefix="c_"),
        O.embed_ctes(QCFG, ids="csrc", prefix="c_", src_terms="c_terms", src_rows="c_term_rows"),
        """cvec AS (SELECT s.conv_id AS seq_id, s.turn AS pos, s.text, list(e.value ORDER BY e.dim) AS v
  FROM c_emb e JOIN csrc s ON s.doc_id = e.doc_id GROUP BY s.conv_id, s.turn, s.text)"""]
LEN_COS = ("(CASE WHEN sqrt(list_sum(list_transform(a.v, lambda x: x * x))) > 0 "
           "AND sqrt(list_sum(list_transform(b.v, lambda x: x * x))) > 0 THEN "
           "list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / "
           "(sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * "
           "sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) ELSE 0.0 END)")
SEQ_SQL = CONV + [f"""cons AS (
  SELECT a.seq_id, a.pos, {LEN_COS} AS similarity, {O.dist_sql('a.v', 'b.v')} AS distance
  FROM cvec a JOIN cvec b ON b.seq_id = a.seq_id AND b.pos = a.pos + 1)""", f"""nonc AS (
  SELECT a.seq_id, {LEN_COS} AS similarity
  FROM cvec a JOIN cvec b ON b.seq_id = a.seq_id AND b.pos >= a.pos + 2)""", """tau AS (
  SELECT c.seq_id,
         coalesce((sum(CASE WHEN round(c.similarity, 9) > round(m.similarity, 9) THEN 1 ELSE 0 END)
                 - sum(CASE WHEN round(c.similarity, 9) < round(m.similarity, 9) THEN 1 ELSE 0 END))
                 / nullif(sum(CASE WHEN round(c.similarity, 9) <> round(m.similarity, 9) THEN 1 ELSE 0 END), 0), 0.0)
           AS kendall_tau
  FROM cons c LEFT JOIN nonc m ON m.seq_id = c.seq_id GROUP BY c.seq_id)""", """perseq AS (
  SELECT c.seq_id, CAST(c.n AS BIGINT) AS n, t.kendall_tau,
         c.cmean - coalesce(m.mmean, 0.0) AS correlation, c.dmean AS average_distance
  FROM (SELECT seq_id, count(*) + 1 AS n, avg(similarity) AS cmean, avg(distance) AS dmean
        FROM cons GROUP BY seq_id) c
  LEFT JOIN (SELECT seq_id, avg(similarity) AS mmean FROM nonc GROUP BY seq_id) m ON m.seq_id = c.seq_id
  JOIN tau t ON t.seq_id = c.seq_id)"""]


def conv_seqs(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("seq_id"), F.col("turn").alias("pos"), "text")


def _seq_emb(spark, sf):
    from bowline.operators.temporal import sequence_embeddings
    return sequence_embeddings(conv_seqs(spark, sf), model(spark, sf))


@register("sequence_consecutive", with_(*SEQ_SQL) + f"""SELECT seq_id, CAST(pos AS BIGINT) AS pos,
       round(similarity, {DIGITS}) AS similarity, round(distance, {DIGITS}) AS distance FROM cons""")
def q_sequence_consecutive(spark, sf):
    from bowline.operators.temporal import consecutive
    c = consecutive(_seq_emb(spark, sf))
    return c.select(F.col("seq_id").cast("long").alias("seq_id"), F.col("pos").cast("long").alias("pos"),
                    r6(F.col("similarity")).alias("similarity"), r6(F.col("distance")).alias("distance"))


@register("sequence_tau", with_(*SEQ_SQL) + f"SELECT seq_id, round(kendall_tau, {DIGITS}) AS kendall_tau FROM tau")
def q_sequence_tau(spark, sf):
    from bowline.operators.temporal import sequence_tau
    t = sequence_tau(_seq_emb(spark, sf))
    return t.select("seq_id", r6(F.col("kendall_tau")).alias("kendall_tau"))


@register("sequence_metrics", with_(*SEQ_SQL) + f"""SELECT seq_id, n, round(kendall_tau, {DIGITS}) AS kendall_tau,
       round(correlation, {DIGITS}) AS correlation, round(average_distance, {DIGITS}) AS average_distance
FROM perseq""")
def q_sequence_metrics(spark, sf):
    from bowline.operators.temporal import sequence_metrics
    m = sequence_metrics(_seq_emb(spark, sf))
    return m.select("seq_id", "n", *[r6(F.col(c)).alias(c) for c in ("kendall_tau", "correlation", "average_distance")])


@register("temporal_metrics", with_(*SEQ_SQL) + f"""SELECT
  round(coalesce(sum(p.kendall_tau), 0.0) / count(*), {DIGITS}) AS kendall_tau,
  round(coalesce(sum(p.correlation), 0.0) / count(*), {DIGITS}) AS correlation_coefficient,
  round(coalesce(sum(p.average_distance), 0.0) / count(*), {DIGITS}) AS average_distance
FROM (SELECT DISTINCT conv_id AS seq_id FROM conversations) s LEFT JOIN perseq p ON p.seq_id = s.seq_id""")
def q_temporal_metrics(spark, sf):
    from bowline.operators.temporal import sequence_metrics, temporal_metrics
    m = temporal_metrics(sequence_metrics(_seq_emb(spark, sf)), conv_seqs(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


RECALL_K = 5
RECALL_SQL = CONV + ["""items AS (
  SELECT CAST(row_number() OVER (ORDER BY seq_id, pos) - 1 AS BIGINT) AS pos, text, v FROM cvec)""",
                     "nitems AS (SELECT count(*) AS n FROM items)", f"""cands AS (
  SELECT pos AS query_pos, pos + 1 AS cand_pos, true AS is_positive
  FROM items WHERE pos % 10 = 0 AND pos < (SELECT n FROM nitems) - 5
  UNION ALL
  SELECT query_pos, cand_pos, false FROM (
    SELECT query_pos, cand_pos, row_number() OVER (PARTITION BY query_pos ORDER BY first) AS nth FROM (
      SELECT query_pos, cand_pos, min(r) AS first FROM (
        SELECT i.pos AS query_pos, r.r,
               CAST(floor({O.draws.uniform_sql(O.draws.key_sql(42, 'neg', 'i.pos', 'r.r'))} * (SELECT n FROM nitems)) AS BIGINT) AS cand_pos
        FROM items i, range(0, (SELECT CASE WHEN n < 76 THEN 380 ELSE 76 END FROM nitems)) r(r)
        WHERE i.pos % 10 = 0 AND i.pos < (SELECT n FROM nitems) - 5
        UNION ALL
        SELECT i.pos, 1000 + r.r, r.r FROM items i, range(0, (SELECT least(19, n) FROM nitems)) r(r)
        WHERE i.pos % 10 = 0 AND i.pos < (SELECT n FROM nitems) - 5)
      GROUP BY query_pos, cand_pos))
  WHERE nth <= 19 AND cand_pos <> query_pos AND cand_pos <> query_pos + 1)"""]


def _recall_items(spark, sf):
    from bowline.operators.positions import dense_positions
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return dense_positions(c, ["conv_id", "turn"]).select("pos", "text")


@register("recall_candidates", with_(*RECALL_SQL) + "SELECT query_pos, cand_pos, is_positive FROM cands")
def q_recall_candidates(spark, sf):
    from bowline.operators.search import recall_candidates
    items = _recall_items(spark, sf)
    return recall_candidates(items.count(), items.select("pos"))


@register("recall_at_k", with_(*RECALL_SQL, f"""scored AS (
  SELECT c.query_pos, c.cand_pos, ci.text AS ctext, {O.cos_sql('qi.v', 'ci.v')} AS sim
  FROM cands c JOIN items qi ON qi.pos = c.query_pos JOIN items ci ON ci.pos = c.cand_pos)""",
    f"""top AS (SELECT * FROM scored QUALIFY row_number() OVER (
  PARTITION BY query_pos ORDER BY round(sim, 9) DESC, cand_pos) <= {RECALL_K})""",
    """perq AS (SELECT t.query_pos, max(CASE WHEN t.ctext = p.text THEN 1 ELSE 0 END) AS hit
  FROM top t JOIN items p ON p.pos = t.query_pos + 1 GROUP BY t.query_pos)""") + f"""SELECT
  count(*) AS n_queries, CAST(coalesce(sum(hit), 0) AS BIGINT) AS hits,
  round(coalesce(avg(hit), 0.0), {DIGITS}) AS recall FROM perq""")
def q_recall_at_k(spark, sf):
    from bowline.operators.search import recall_at_k
    _, summary = recall_at_k(_recall_items(spark, sf), model(spark, sf), RECALL_K)
    return summary.select("n_queries", "hits", r6(F.col("recall")).alias("recall"))


# ---- C1-C11 clustering on the embeddings table ---------------------------------------

def _n_labels(spark, sf) -> int:
    return table(spark, sf, "embeddings").select("label").distinct().count()


def _kmeans_step(spark, sf, limits=DEFAULT_LIMITS, keep_vector=False):
    from bowline.operators.clustering import assign, initial_centroids
    v = vectors(spark, sf)
    cen = initial_centroids(v, _n_labels(spark, sf), 42)
    return v, cen, assign(v, cen, limits=limits, keep_vector=keep_vector)


CLU = ["ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)",
       f"""cen AS (SELECT CAST(rn - 1 AS INTEGER) AS cluster, v FROM (
  SELECT vec_id, v, row_number() OVER (ORDER BY u, vec_id) AS rn FROM (
    SELECT vec_id, v, {O.draws.uniform_sql(O.draws.key_sql(42, 'init', 'vec_id'))} AS u FROM ev))
  WHERE rn <= (SELECT count(DISTINCT label) FROM ev))""",
       """asg AS (SELECT vec_id, cluster FROM (
  SELECT e.vec_id, c.cluster, row_number() OVER (PARTITION BY e.vec_id ORDER BY
    list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster) AS rn
  FROM ev e, cen c) WHERE rn = 1)""",
       """li AS (SELECT label, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS label_idx
  FROM (SELECT label, min(vec_id) AS first FROM ev GROUP BY label))""",
       """cont AS (SELECT a.cluster, l.label_idx, count(*) AS n FROM asg a JOIN ev e ON e.vec_id = a.vec_id
  JOIN li l ON l.label = e.label GROUP BY a.cluster, l.label_idx)""",
       """crow AS (SELECT cluster, sum(n) AS a, max(n) AS mx FROM cont GROUP BY cluster)""",
       """ccol AS (SELECT label_idx, sum(n) AS b FROM cont GROUP BY label_idx)""",
       """cs AS (SELECT t.n, t.sc, t.snl, r.correct, r.sa, r.sal, c.sb, c.sbl FROM
  (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(n * (n - 1) / 2.0) AS sc, sum(n * ln(n)) AS snl FROM cont) t,
  (SELECT sum(mx) AS correct, sum(a * (a - 1) / 2.0) AS sa, sum(a * ln(a)) AS sal FROM crow) r,
  (SELECT sum(b * (b - 1) / 2.0) AS sb, sum(b * ln(b)) AS sbl FROM ccol) c)""",
       """scores AS (SELECT correct / n AS purity,
  (n * (n - 1) / 2.0 + 2 * sc - sa - sb) / (n * (n - 1) / 2.0) AS rand_index,
  CASE WHEN (ln(n) - sal / n) + (ln(n) - sbl / n) > 0
       THEN 2 * ((snl + n * ln(n) - sal - sbl) / n) / ((ln(n) - sal / n) + (ln(n) - sbl / n)) ELSE 0.0 END AS nmi_true
  FROM cs)"""]


@register("kmeans_assign", with_(*CLU[:3]) + "SELECT vec_id, cluster FROM asg")
def q_kmeans_assign(spark, sf):
    return _kmeans_step(spark, sf)[2]


@register("kmeans_update", with_(*CLU[:3], """upd AS (
  SELECT a.cluster, CAST(generate_subscripts(e.v, 1) - 1 AS INTEGER) AS dim, unnest(e.v) AS x
  FROM asg a JOIN ev e ON e.vec_id = a.vec_id)""",
    "means AS (SELECT cluster, dim, avg(x) AS x FROM upd GROUP BY cluster, dim)",
    """cenl AS (SELECT cluster, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, unnest(v) AS x FROM cen)""") +
    f"""SELECT c.cluster, c.dim, round(coalesce(m.x, c.x), {DIGITS}) AS value
FROM cenl c LEFT JOIN means m ON m.cluster = c.cluster AND m.dim = c.dim""")
def q_kmeans_update(spark, sf):
    from bowline.operators.clustering import update
    _, cen, a = _kmeans_step(spark, sf, keep_vector=True)
    return long_vectors(update(a, cen), "cluster", "v")


@register("kmeans_assign_blocked", SQL["kmeans_assign"])
def q_kmeans_assign_blocked(spark, sf):
    return _kmeans_step(spark, sf, Limits(broadcast_bytes=3 * 65 * 8))[2]


KMEANS_ROUNDS = 3


def _lloyd_sql() -> str:
    """KMEANS_ROUNDS assign and update steps, unrolled."""
    ctes, before = [CLU[0], CLU[1].replace("cen AS", "c0 AS", 1)], "c0"
    for i in range(1, KMEANS_ROUNDS + 1):
        ctes.append(CLU[2].replace("asg AS", f"a{i} AS", 1).replace("ev e, cen c", f"ev e, {before} c"))
        ctes.append(f"""x{i} AS (SELECT a.cluster, generate_subscripts(e.v, 1) AS dim, unnest(e.v) AS x
  FROM a{i} a JOIN ev e ON e.vec_id = a.vec_id)""")
        ctes.append(f"""m{i} AS (SELECT cluster, list(x ORDER BY dim) AS v FROM
  (SELECT cluster, dim, avg(x) AS x FROM x{i} GROUP BY cluster, dim) GROUP BY cluster)""")
        ctes.append(f"c{i} AS (SELECT b.cluster, coalesce(m.v, b.v) AS v FROM {before} b LEFT JOIN m{i} m ON m.cluster = b.cluster)")
        before = f"c{i}"
    return with_(*ctes) + f"""SELECT cluster, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim,
  unnest(list_transform(v, lambda x: round(x, {DIGITS}))) AS value FROM {before}"""


@register("kmeans_steps", _lloyd_sql())
def q_kmeans_steps(spark, sf):
    from bowline.operators.clustering import initial_centroids, lloyd
    v = vectors(spark, sf)
    return long_vectors(lloyd(v, initial_centroids(v, _n_labels(spark, sf), 42), KMEANS_ROUNDS), "cluster", "v")


@register("kmeans_fixed_point", "SELECT CAST(0 AS BIGINT) AS moved, count(*) AS points FROM embeddings")
def q_kmeans_fixed_point(spark, sf):
    """Another assign and update step moves no point of the fitted clustering."""
    from bowline.operators.clustering import assign, kmeans_fit, update
    v = vectors(spark, sf)
    fitted = materialize(kmeans_fit(v, _n_labels(spark, sf), 100, 42), "kmeans")
    named = fitted.join(v, "vec_id").select("vec_id", "cluster", "v")
    start = named.groupBy("cluster").agg(F.first("v").alias("v"))  # replaced by the means of its members
    again = assign(v, update(named, start)).withColumnRenamed("cluster", "now")
    moved = (F.col("now") != F.col("cluster")).cast("long")
    return fitted.join(again, "vec_id").agg(F.sum(moved).alias("moved"), F.count(F.lit(1)).alias("points"))


@register("contingency", with_(*CLU[:5]) + "SELECT cluster, label_idx, n FROM cont")
def q_contingency(spark, sf):
    from bowline.operators.clustering import contingency
    v, _, a = _kmeans_step(spark, sf)
    return contingency(a, v)


def _scores(spark, sf):
    from bowline.operators.clustering import cluster_scores, contingency
    v, _, a = _kmeans_step(spark, sf)
    return cluster_scores(contingency(a, v))


@register("cluster_purity", with_(*CLU) + f"SELECT round(purity, {DIGITS}) AS purity FROM scores")
def q_cluster_purity(spark, sf):
    return _scores(spark, sf).select(r6(F.col("purity")).alias("purity"))


@register("cluster_rand_index", with_(*CLU) + f"SELECT round(rand_index, {DIGITS}) AS rand_index FROM scores")
def q_cluster_rand_index(spark, sf):
    return _scores(spark, sf).select(r6(F.col("rand_index")).alias("rand_index"))


@register("cluster_metrics", with_(*CLU) + f"""SELECT round(purity, {DIGITS}) AS purity,
  round((purity + rand_index) / 2, {DIGITS}) AS normalized_mutual_information,
  round(rand_index, {DIGITS}) AS rand_index FROM scores""")
def q_cluster_metrics(spark, sf):
    s = _scores(spark, sf)
    return s.select(*[r6(F.col(c)).alias(c) for c in ("purity", "normalized_mutual_information", "rand_index")])


@register("cluster_nmi_true", with_(*CLU) + f"SELECT round(nmi_true, {DIGITS}) AS nmi_true FROM scores")
def q_cluster_nmi_true(spark, sf):
    return _scores(spark, sf).select(r6(F.col("nmi_true")).alias("nmi_true"))


def fitted_ctes(points: str, k: str, rounds: int = 100) -> list[str]:
    """k-means to its stop rule as a recursive query over ``points`` (id, v): fit_out (id, cluster).

    A step's rows are the centroids (kind 0, with the step's moved points) and the assigned points (kind 1).
    """
    nearest = """SELECT id, v, was, cluster FROM (
      SELECT p.id, p.v, {was} AS was, c.cluster, row_number() OVER (PARTITION BY p.id ORDER BY
        list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster) AS rn
      FROM {points} p, {cents} c) WHERE rn = 1"""
    return [f"""fit0 AS (SELECT CAST(rn - 1 AS INTEGER) AS cluster, v FROM (
  SELECT id, v, row_number() OVER (ORDER BY u, id) AS rn FROM (
    SELECT id, v, {O.draws.uniform_sql(O.draws.key_sql(42, 'init', 'id'))} AS u FROM {points}))
  WHERE rn <= {k})""",
            f"""fit(round, kind, id, cluster, v, moved) AS (
  SELECT 0, 0, CAST(NULL AS BIGINT), cluster, v, CAST(1 AS BIGINT) FROM fit0
  UNION ALL
  SELECT 0, 1, id, 0, v, CAST(1 AS BIGINT) FROM {points}
  UNION ALL
  (WITH now AS (SELECT * FROM fit WHERE moved > 0 AND round < {rounds}),
   cents AS (SELECT cluster, v FROM now WHERE kind = 0),
   pts AS (SELECT id, v, cluster AS was FROM now WHERE kind = 1),
   a AS ({nearest.format(was="p.was", points="pts", cents="cents")}),
   x AS (SELECT cluster, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM a),
   m AS (SELECT cluster, list(x ORDER BY dim) AS v FROM (SELECT cluster, dim, avg(x) AS x FROM x GROUP BY cluster, dim) GROUP BY cluster),
   g AS (SELECT count(*) FILTER (was <> cluster) AS moved FROM a),
   r AS (SELECT max(round) + 1 AS round FROM now)
   SELECT r.round, 0, CAST(NULL AS BIGINT), c.cluster, coalesce(m.v, c.v), g.moved FROM cents c LEFT JOIN m ON m.cluster = c.cluster, g, r
   UNION ALL
   SELECT r.round, 1, a.id, a.cluster, a.v, g.moved FROM a, g, r))""",
            "fit_out AS (SELECT id, cluster FROM fit WHERE kind = 1 AND round = (SELECT max(round) FROM fit))"]


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


@register("kmeans_fit", with_recursive(
    "pts0 AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    *fitted_ctes("pts0", "(SELECT count(DISTINCT label) FROM embeddings)")) + "SELECT id AS vec_id, cluster FROM fit_out")
def q_kmeans_fit(spark, sf):
    from bowline.operators.clustering import kmeans_fit
    return kmeans_fit(vectors(spark, sf), _n_labels(spark, sf), 100, 42)


# ---- G1-G5 stability on the documents table ---------------------------------------------

N_VARIANTS, MUTATION_RATE = 3, 0.3
_u = O.draws.uniform_sql
_k = O.draws.key_sql
VARIANTS = [O.corpus_cte(), f"""vbase AS (
  SELECT doc_id, text, CASE WHEN tt = '' THEN [] ELSE regexp_split_to_array(tt, '{O.WS}+') END AS words
  FROM (SELECT doc_id, text, regexp_replace(text, '^{O.WS}+|{O.WS}+$', '', 'g') AS tt FROM corpus))""",
            f"vfan AS (SELECT doc_id, text, words, r.variant FROM vbase, range(1, {N_VARIANTS + 1}) r(variant))",
            """vw AS (SELECT doc_id, variant, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS pos,
  unnest(words) AS word FROM vfan)""", f"""vh AS (
  SELECT *, md5({_k(42, 'variant', 'doc_id', 'variant', 'pos')}) AS h FROM vw)""", f"""vd AS (
  SELECT doc_id, variant, pos, word,
         CASE WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) / {O.draws.TWO_32!r} < {MUTATION_RATE}
              THEN CAST(floor(CAST('0x' || substr(h, 9, 8) AS BIGINT) / {O.draws.TWO_32!r} * 4) AS INTEGER)
              ELSE -1 END AS k,
         CAST(floor(CAST('0x' || substr(h, 17, 8) AS BIGINT) / {O.draws.TWO_32!r} * length(word)) AS INTEGER) AS ci
  FROM vh)""", """vk AS (SELECT *, (k <> 2 OR row_number() OVER (PARTITION BY doc_id, variant ORDER BY pos) = 1) AS anchor
  FROM vd WHERE k <> 0)""", """vg AS (SELECT *, sum(CASE WHEN anchor THEN 1 ELSE 0 END) OVER (
  PARTITION BY doc_id, variant ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM vk)""",
            """ve AS (
  SELECT doc_id, variant, grp AS g, 1 AS s, pos, word AS w FROM vg WHERE NOT anchor
  UNION ALL SELECT doc_id, variant, grp, 0, pos, word FROM vg WHERE anchor AND k = 1
  UNION ALL SELECT doc_id, variant, grp, 2, pos,
    CASE WHEN k = 3 AND length(word) >= 3 THEN substring(word, 1, ci) || substring(word, ci + 2, length(word))
         ELSE word END FROM vg WHERE anchor)""",
            "vj AS (SELECT doc_id, variant, string_agg(w, ' ' ORDER BY g, s, pos) AS vt FROM ve GROUP BY doc_id, variant)",
            """variants AS (SELECT f.doc_id, f.variant,
  CASE WHEN len(f.words) = 0 THEN f.text ELSE coalesce(j.vt, '') END AS variant_text
  FROM vfan f LEFT JOIN vj j ON j.doc_id = f.doc_id AND j.variant = f.variant)"""]
VSIM = VARIANTS + [O.terms_ctes(), O.vocab_ctes(QCFG), O.projection_cte(QCFG), O.embed_ctes(QCFG),
                   O.embvec_cte("emb", "dv"),
                   f"vsrc AS (SELECT doc_id * {N_VARIANTS} + variant - 1 AS doc_id, variant_text AS text FROM variants)",
                   O.terms_ctes("vsrc", prefix="v_"),
                   O.embed_ctes(QCFG, ids="vsrc", prefix="v_", src_terms="v_terms", src_rows="v_term_rows"),
                   O.embvec_cte("v_emb", "vv"), f"""vs AS (
  SELECT d.doc_id, CAST(v.doc_id % {N_VARIANTS} + 1 AS INTEGER) AS variant, {O.cos_sql('v.v', 'd.v')} AS similarity
  FROM vv v JOIN dv d ON d.doc_id = v.doc_id // {N_VARIANTS})"""]


@register("text_variants", with_(*VARIANTS) + "SELECT doc_id, CAST(variant AS INTEGER) AS variant, variant_text FROM variants")
def q_text_variants(spark, sf):
    from bowline.operators.stability import text_variants
    return text_variants(docs(spark, sf), N_VARIANTS, MUTATION_RATE, 42)


@register("variant_similarity", with_(*VSIM) +
          f"SELECT doc_id, variant, round(similarity, {DIGITS}) AS similarity FROM vs")
def q_variant_similarity(spark, sf):
    from bowline.operators.stability import variant_similarity
    s = variant_similarity(docs(spark, sf), model(spark, sf), N_VARIANTS, MUTATION_RATE, 42)
    return s.select("doc_id", "variant", r6(F.col("similarity")).alias("similarity"))


@register("stability_metrics", with_(*VSIM) + f"""SELECT
  round(coalesce(avg(similarity), 0.0), {DIGITS}) AS average_similarity,
  round(CASE WHEN count(*) > 0 THEN least(1.0, min(similarity)) ELSE 0.0 END, {DIGITS}) AS min_similarity,
  round(CASE WHEN count(*) > 0 THEN greatest(0.0, max(similarity)) ELSE 0.0 END, {DIGITS}) AS max_similarity,
  round(coalesce(stddev_pop(similarity), 0.0), {DIGITS}) AS standard_deviation FROM vs""")
def q_stability_metrics(spark, sf):
    from bowline.operators.stability import stability_metrics, variant_similarity
    m = stability_metrics(variant_similarity(docs(spark, sf), model(spark, sf), N_VARIANTS, MUTATION_RATE, 42))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


# ---- E8 store, S2/S3 round trip ----------------------------------------------------------

def _store(spark, sf):
    """Vectors of every third document, one of the texts held twice, and the documents."""
    from bowline.operators.embed import embed, embed_with_store
    m, d = model(spark, sf), docs(spark, sf)
    part = embed(d.filter(F.col("doc_id") % 3 == 0), m, carry=["text"]).select("doc_id", "text", "embedding")
    part = materialize(part, "store")
    twice = part.filter(F.col("doc_id") == 0)
    store = part.unionByName(twice).select("text", "embedding")
    return embed_with_store(d, store, m)


@register("embed_incremental", EMB + f"SELECT doc_id, dim, round(value, {DIGITS}) AS value FROM emb")
def q_embed_incremental(spark, sf):
    return long_vectors(_store(spark, sf)[0], "doc_id", "embedding")


@register("project_dense_hot", SQL["project_dense"])
def q_project_dense_hot(spark, sf):
    """E3 with a projection over the limit: hot indexes are sent their rows, the others are joined."""
    from bowline.operators.embed import bm25_weights, project_sums
    m = model(spark, sf)
    return project_sums(bm25_weights(docs(spark, sf), m), m, Limits(broadcast_bytes=1 << 16)).select(
        "doc_id", "dim", r6(F.col("value")).alias("value"))


@register("store_grown", EMB.rstrip() + f""",
held AS (SELECT text, count(*) + max(CASE WHEN doc_id = 0 THEN 1 ELSE 0 END) AS copies FROM corpus
         WHERE doc_id % 3 = 0 GROUP BY text),
first AS (SELECT c.text, min(c.doc_id) AS doc_id, coalesce(max(h.copies), 1) AS copies
          FROM corpus c LEFT JOIN held h ON h.text = c.text GROUP BY c.text)
SELECT md5(f.text) AS text_md5, CAST(f.copies AS BIGINT) AS copies, e.dim, round(e.value, {DIGITS}) AS value
FROM first f JOIN emb e ON e.doc_id = f.doc_id""")
def q_store_grown(spark, sf):
    from bowline.operators.embed import text_digest
    # a text is grouped by its digest, as the store looks it up, so that no text is shuffled or sorted
    grown = _store(spark, sf)[1].groupBy(text_digest(F.col("text")).alias("d")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("e"))
    return grown.select(F.lower(F.hex("d.md5")).alias("text_md5"), "copies", F.posexplode("e").alias("dim", "value")) \
        .select("text_md5", "copies", F.col("dim").cast("int").alias("dim"), r6(F.col("value")).alias("value"))


@register("model_roundtrip", VOCAB + f"""SELECT idx, token, token_count, doc_freq,
       round(idf, {DIGITS}) AS idf FROM vocab""")
def q_model_roundtrip(spark, sf):
    from bowline.session import work_path
    from bowline.sources import model_io
    m = model(spark, sf)
    path = work_path(spark, "model-copy")
    model_io.save(m, path)
    back = model_io.load(spark, path)
    return back.vocabulary.select("idx", "token", "token_count", "doc_freq", r6(F.col("idf")).alias("idf"))


@register("sequence_nonconsecutive", with_(*SEQ_SQL) + f"""SELECT c.seq_id,
       CAST(coalesce(m.n_pairs, 0) AS BIGINT) AS n_pairs, round(coalesce(m.mmean, 0.0), {DIGITS}) AS mean_similarity
FROM (SELECT DISTINCT seq_id FROM cons) c
LEFT JOIN (SELECT seq_id, count(*) AS n_pairs, avg(similarity) AS mmean FROM nonc GROUP BY seq_id) m
  ON m.seq_id = c.seq_id""")
def q_sequence_nonconsecutive(spark, sf):
    from bowline.operators.temporal import nonconsecutive
    m = nonconsecutive(_seq_emb(spark, sf))
    return m.select("seq_id", "n_pairs", r6(F.col("mean_similarity")).alias("mean_similarity"))


_EVAL_LABELLED = """labelled AS (SELECT c.doc_id, c.text, l.quality AS label FROM corpus c JOIN labels l ON l.doc_id = c.doc_id)"""


@register("cluster_evaluate", with_recursive(
    O.corpus_cte(), O.terms_ctes(), O.vocab_ctes(QCFG), O.projection_cte(QCFG), _EVAL_LABELLED,
    O.embed_ctes(QCFG), O.embvec_cte("emb", "docvec", "id"),
    "pts0 AS (SELECT d.id, d.v FROM docvec d JOIN labelled l ON l.doc_id = d.id)",
    *fitted_ctes("pts0", "(SELECT count(DISTINCT label) FROM labelled)"),
    """ev AS (SELECT doc_id AS vec_id, label FROM labelled)""", "asg AS (SELECT id AS vec_id, cluster FROM fit_out)",
    *CLU[3:]) + f"""SELECT round(purity, {DIGITS}) AS purity,
  round((purity + rand_index) / 2, {DIGITS}) AS normalized_mutual_information,
  round(rand_index, {DIGITS}) AS rand_index FROM scores""")
def q_cluster_evaluate(spark, sf):
    from bowline.operators.clustering import evaluate_clustering
    labelled = docs(spark, sf).join(
        table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    m = evaluate_clustering(labelled, model(spark, sf), "doc_id", "label", "text", 100, 42)
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])
