"""SQL twins of the query catalog, in DuckDB's dialect, for the oracle check.

The CTE builders below restate each operator's definition in plain SQL over
the driver's tables; the Spark side never runs this text.
"""

from __future__ import annotations

from bowline.config import ModelConfig
from bowline.functions import draws
from bowline.functions.text import MIN_TOKEN_BYTES, STOP_WORDS

STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
# Unicode White_Space, spelled for RE2
WS = r"[\x{9}-\x{D}\x{85}\p{Z}]"
SPLIT = r"[^\p{L}\p{N}]+"


def corpus_cte(table: str = "documents", id_col: str = "doc_id", text_col: str = "text",
               name: str = "corpus") -> str:
    return f"""{name} AS (
  SELECT doc_id, text FROM (
    SELECT {id_col} AS doc_id,
           regexp_replace({text_col}, '^{WS}+|{WS}+$', '', 'g') AS text
    FROM {table} WHERE {text_col} IS NOT NULL) WHERE text <> '')"""


def tokens_expr(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower(nfc_normalize({text})), '{SPLIT}'), "
            f"lambda x: strlen(x) >= {MIN_TOKEN_BYTES} AND NOT list_contains({STOP_LIST}, x))")


def bigrams_expr(tokens: str) -> str:
    return (f"CASE WHEN len({tokens}) >= 2 THEN list_transform(range(1, len({tokens})), "
            f"lambda i: {tokens}[i] || '_' || {tokens}[i + 1]) ELSE [] END")


def terms_ctes(src: str = "corpus", use_ngrams: bool = True, prefix: str = "") -> str:
    """tokens / terms / term_rows CTEs over a (doc_id, text) relation."""
    p = prefix
    terms = (f"list_concat(tokens, {bigrams_expr('tokens')})" if use_ngrams else "tokens")
    return f"""{p}tokens AS (SELECT doc_id, {tokens_expr('text')} AS tokens FROM {src}),
{p}terms AS (SELECT doc_id, {terms} AS terms FROM {p}tokens),
{p}term_rows AS (SELECT doc_id, unnest(terms) AS token FROM {p}terms)"""


def vocab_ctes(cfg: ModelConfig, src: str = "corpus") -> str:
    return f"""stats AS (
  SELECT token, count(*) AS token_count, count(DISTINCT doc_id) AS doc_freq
  FROM term_rows GROUP BY token),
n_docs AS (SELECT count(*) AS n FROM {src}),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY token_count DESC, token) - 1 AS INTEGER) AS idx,
         token, token_count, doc_freq,
         ln(((SELECT n FROM n_docs) + 1.0) / (doc_freq + 0.5)) AS idf
  FROM (SELECT * FROM stats WHERE token_count >= {cfg.min_token_frequency}
        ORDER BY token_count DESC, token LIMIT {cfg.max_vocabulary_size}))"""


def projection_cte(cfg: ModelConfig, name: str = "proj") -> str:
    k = draws.key_sql(cfg.random_seed, "proj", "idx", "j")
    if cfg.use_orthogonal_init:
        return f"""{name}_raw AS (
  SELECT idx, CAST(j AS INTEGER) AS dim, {draws.normal_sql(k)} AS x
  FROM vocab, range(0, {cfg.embedding_dim}) r(j)),
{name} AS (
  SELECT idx, dim, CASE WHEN nrm > 1e-8 THEN x / nrm ELSE x END AS pval
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY idx)) AS nrm FROM {name}_raw))"""
    s = f"sqrt(6.0 / ((SELECT count(*) FROM vocab) + {cfg.embedding_dim}))"
    return f"""{name} AS (
  SELECT idx, CAST(j AS INTEGER) AS dim, -{s} + 2 * {s} * {draws.uniform_sql(k)} AS pval
  FROM vocab, range(0, {cfg.embedding_dim}) r(j))"""


def weights_ctes(cfg: ModelConfig, dropout: float = 0.0, prefix: str = "",
                 src_terms: str = "terms", src_rows: str = "term_rows") -> str:
    """tf / weights over a terms relation; dropout filter keyed by (doc_id, token)."""
    p = prefix
    keep = ""
    scale = ""
    if dropout > 0.0:
        k = draws.key_sql(cfg.random_seed, "drop", "t.doc_id", "t.token")
        keep = f"WHERE {draws.uniform_sql(k)} >= {dropout!r}"
        scale = f" / (1.0 - {dropout!r})"
    return f"""{p}tf AS (
  SELECT t.doc_id, t.token, count(*) AS tf FROM {src_rows} t GROUP BY t.doc_id, t.token),
{p}tfv AS (
  SELECT t.doc_id, v.idx, v.token, t.tf, len(x.terms) AS n_terms, v.idf
  FROM {p}tf t JOIN vocab v ON v.token = t.token JOIN {src_terms} x ON x.doc_id = t.doc_id
  {keep}),
{p}w AS (
  SELECT doc_id, idx,
         2.2 * (CAST(tf AS DOUBLE) / n_terms) / (1.2 + CAST(tf AS DOUBLE) / n_terms) * idf{scale}
           AS weight
  FROM {p}tfv)"""


def embed_ctes(cfg: ModelConfig, ids: str = "corpus", prefix: str = "", dropout: float = 0.0,
               src_terms: str = "terms", src_rows: str = "term_rows") -> str:
    """{prefix}emb(doc_id, dim, value): unit-normalized long-form embeddings."""
    p = prefix
    return f"""{weights_ctes(cfg, dropout, p, src_terms, src_rows)},
{p}dense AS (
  SELECT w.doc_id, pr.dim, sum(w.weight * pr.pval) AS value
  FROM {p}w w JOIN proj pr ON pr.idx = w.idx GROUP BY w.doc_id, pr.dim),
{p}filled AS (
  SELECT c.doc_id, CAST(r.j AS INTEGER) AS dim, coalesce(d.value, 0.0) AS value
  FROM {ids} c CROSS JOIN range(0, {cfg.embedding_dim}) r(j)
  LEFT JOIN {p}dense d ON d.doc_id = c.doc_id AND d.dim = r.j),
{p}emb AS (
  SELECT doc_id, dim, CASE WHEN nrm > 1e-10 THEN value / nrm ELSE value END AS value
  FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS nrm FROM {p}filled))"""


def embvec_cte(src: str, name: str, id_name: str = "doc_id") -> str:
    """Collect a long-form embedding into (id, v DOUBLE[]) ordered by dim."""
    return f"""{name} AS (
  SELECT doc_id AS {id_name}, list(value ORDER BY dim) AS v FROM {src} GROUP BY doc_id)"""


def cos_sql(a: str, b: str, eps: float = 1e-10) -> str:
    """Strict cosine of two DOUBLE[] expressions (0 when a norm is small)."""
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    na = f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
    nb = f"sqrt(list_sum(list_transform({b}, lambda x: x * x)))"
    return f"(CASE WHEN {na} > {eps} AND {nb} > {eps} THEN {dot} / ({na} * {nb}) ELSE 0.0 END)"


def dist_sql(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def vec_sql(col: str) -> str:
    return f"CAST({col} AS DOUBLE[])"
