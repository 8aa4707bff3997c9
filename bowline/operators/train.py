"""Training: token statistics, vocabulary, IDF and projection matrix.

Plan shape at scale: one narrow stage tokenizes the documents and counts the
terms of every run of rows on their codes; one shuffle by token (with map-side
partial aggregation, so frequent tokens are pre-summed per partition) yields
token and document frequencies. The statistics are written once to the shared
checkpoint folder; everything after works on that table or on the at most
``max_vocabulary_size`` rows of the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bowline.config import ModelConfig
from bowline.functions import draws
from bowline.functions import text as T
from bowline.functions import tokens
from bowline.functions.md5 import keyed, md5_words
from bowline.functions.vectors import PROJECTION_ROW_EPS
from bowline.session import estimated_bytes, materialize

BUCKETS = 1 << 20       # hash buckets of frequent_stats: a task sends at most one row for each
PRUNE_BYTES = 16 << 20  # size of a corpus from which rare tokens outweigh one more read
_ROWS = 1 << 16


def document_terms(corpus: DataFrame, use_ngrams: bool = True) -> DataFrame:
    """T6 on a table: (doc_id, terms ARRAY<STRING>)."""
    return corpus.select("doc_id", T.process_text(F.col("text"), use_ngrams).alias("terms"))


def term_bags(corpus: DataFrame, use_ngrams: bool = True) -> DataFrame:
    """(doc_id, bag ARRAY<STRUCT<token, tf>>, n_terms) — built inside each row."""
    bag = T.term_bag(T.process_text(F.col("text"), use_ngrams))
    keep = [c for c in corpus.columns if c != "text"]
    return (corpus.select(*keep, bag.alias("bag"))
            .withColumn("n_terms", F.aggregate("bag", F.lit(0), lambda acc, e: acc + e["tf"])))


def _run_counts(use_ngrams: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for t in tokens.token_runs(batch.column(0)):
                terms, total, docs = tokens.counts(t, use_ngrams)
                yield pa.RecordBatch.from_arrays([terms, pa.array(total), pa.array(docs)],
                                                 names=["token", "token_count", "doc_freq"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0]), pa.array([rows])],
                                         names=["token", "token_count", "doc_freq"])
    return run


def term_counts(corpus: DataFrame, use_ngrams: bool = True) -> DataFrame:
    """(token, token_count, doc_freq) of every run of documents.

    Every task also gives a row with a NULL token, whose doc_freq is its number of documents.
    """
    return corpus.select(T.normalize(F.col("text")).alias("text")).mapInArrow(
        _run_counts(use_ngrams), "token string, token_count long, doc_freq long")


def token_stats(corpus: DataFrame, use_ngrams: bool = True) -> DataFrame:
    """V1 + V2 + V3 in one aggregation.

    (token, token_count, doc_freq). The NULL token's doc_freq is the corpus size, documents without
    tokens included.
    """
    return _summed(term_counts(corpus, use_ngrams))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.sum("token_count").alias("token_count"), F.sum("doc_freq").alias("doc_freq"))


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def _bucket_counts(use_ngrams: bool, buckets: int, n_max: int):
    """(bucket, token, n, docs): a task's sum for each bucket; each run's most frequent tokens; the documents (both null)."""
    def rows(bucket, token, n, docs) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([bucket, token, pa.array(n), docs], names=["bucket", "token", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros(buckets, np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for t in tokens.token_runs(batch.column(0)):
                terms = tokens.run_terms(t, use_ngrams)
                np.add.at(sums, _bucket_of(terms.hashes(), buckets), terms.total)
                top = np.arange(len(terms.total))
                if n_max < len(top):
                    top = np.sort(np.argpartition(-terms.total, n_max)[:n_max])
                    top = top[terms.total[top] > 1]  # most terms of a run occur once in it
                if len(top):
                    yield rows(pa.nulls(len(top), pa.int64()), terms.names(top), terms.total[top], pa.nulls(len(top), pa.int64()))
        used = np.flatnonzero(sums)
        for at in (used[a:a + _ROWS] for a in range(0, len(used), _ROWS)):
            yield rows(pa.array(at), pa.nulls(len(at), pa.string()), sums[at], pa.nulls(len(at), pa.int64()))
        yield rows(pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), [0], pa.array([seen]))
    return run


def _counts_within(bc, use_ngrams: bool, buckets: int):
    """As ``_run_counts`` for the tokens of the buckets that ``bc`` marks, without the row of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(bc.value, count=buckets).astype(np.bool_)
        for batch in batches:
            for t in tokens.token_runs(batch.column(0)):
                terms = tokens.run_terms(t, use_ngrams)
                at = np.flatnonzero(may[_bucket_of(terms.hashes(), buckets)])
                yield pa.RecordBatch.from_arrays([terms.names(at), pa.array(terms.total[at]), pa.array(terms.docs[at])],
                                                 names=["token", "token_count", "doc_freq"])
    return run


def frequent_stats(corpus: DataFrame, config: ModelConfig, buckets: int = BUCKETS,
                   spare: float = 0.0) -> DataFrame:
    """V1 + V2 + V3 as ``token_stats`` gives them, for all tokens that can get into the vocabulary.

    At scale most distinct tokens are rare bigrams, and they would be most of the exact shuffle. So:

    1. one pass over all documents sums the occurrences of all tokens in hash buckets, and those of the
       most frequent tokens of every run of documents by name. What is summed by name is at most a
       token's count, so the N-th largest of these sums is a count that at least N tokens reach, and no
       token below it gets in;
    2. a token of a bucket whose sum is below that count (or the minimum frequency) is rarer still and
       stays out of the second pass, which counts the others exactly.

    A run names N tokens and a share ``spare`` of N more; the vocabulary is the same whatever it names, and
    only the pruning differs. Tokens are hashed and counted where their text is read, so a task sends at most
    one row for each bucket, the named tokens of its runs, and the counts of tokens of full buckets.
    """
    n_max = config.max_vocabulary_size
    text = corpus.select(T.normalize(F.col("text")).alias("text"))
    counts = materialize(
        text.mapInArrow(_bucket_counts(config.use_ngrams, buckets, math.ceil(n_max * (1.0 + spare))),
                        "bucket long, token string, n long, docs long")
        .groupBy("bucket", "token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "bucket-counts")
    by_name = counts.filter(F.col("token").isNotNull()).orderBy(F.desc("n")).limit(n_max)
    nth = by_name.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).first()
    least = max(config.min_token_frequency, nth["n"] if n_max and nth["k"] == n_max else 0)
    # at most ``buckets`` rows of one number
    may = np.zeros(buckets, np.bool_)
    may[counts.filter((F.col("n") >= least) & F.col("bucket").isNotNull()).select("bucket").toArrow()
        .column("bucket").to_numpy()] = True
    bc = corpus.sparkSession.sparkContext.broadcast(np.packbits(may))
    docs = counts.filter(F.col("docs").isNotNull()).select(
        F.lit(None).cast("string").alias("token"), F.lit(None).cast("long").alias("token_count"), F.col("docs").alias("doc_freq"))
    exact = text.mapInArrow(_counts_within(bc, config.use_ngrams, buckets), "token string, token_count long, doc_freq long")
    return _summed(exact).unionByName(docs)


@dataclass
class Model:
    """A trained model: two tables plus the config.

    ``vocabulary``: (idx INT, token STRING, token_count BIGINT, doc_freq BIGINT, idf DOUBLE)
    ``projection``: (idx INT, vec ARRAY<DOUBLE>), one row per vocabulary entry.
    """

    config: ModelConfig
    vocabulary: DataFrame
    projection: DataFrame
    n_docs: int
    vocab_size: int
    path: str | None = None
    token_bytes: int | None = None  # counted when first needed
    broadcasts: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def embedding_dim(self) -> int:
        return self.config.embedding_dim


def select_vocabulary(stats: DataFrame, n_docs: int, config: ModelConfig,
                      take_rows: int | None = None) -> DataFrame:
    """V4-V7: frequency filter, top-N by (count desc, token), dense index, IDF.

    The cut count comes from a histogram of counts (one row per distinct
    count value). Tokens above it are all in. Among the tokens at the cut
    count, the smallest ones are chosen by descending token-prefix
    histograms: a whole prefix group is in or out, so the final ordered take
    only sees the undecided group once it holds at most ``take_rows`` (N)
    rows. The global row_number then runs on at most N rows.
    """
    n_max = config.max_vocabulary_size
    kept = stats.filter(F.col("token").isNotNull()
                        & (F.col("token_count") >= config.min_token_frequency))
    hist = (kept.groupBy("token_count").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("token_count")).limit(n_max + 1).collect())
    taken, cut, ties, n_at_cut = 0, None, 0, 0
    for row in hist:
        if taken + row["n"] > n_max:
            cut, ties, n_at_cut = row["token_count"], n_max - taken, row["n"]
            break
        taken += row["n"]
    if cut is None:
        top = kept
    else:
        top = kept.filter(F.col("token_count") > cut).unionByName(
            _smallest_tokens(kept.filter(F.col("token_count") == cut), ties, n_at_cut,
                             take_rows or n_max))
    order = Window.orderBy(F.desc("token_count"), F.asc("token"))
    return (top.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
            .select("idx", "token", "token_count", "doc_freq",
                    F.log((F.lit(float(n_docs)) + 1.0) / (F.col("doc_freq") + 0.5)).alias("idf")))


def _smallest_tokens(ties: DataFrame, need: int, n_ties: int, take_rows: int) -> DataFrame:
    """The ``need`` smallest tokens of ``ties`` (``n_ties`` rows), exactly.

    Tokens are grouped by their first L characters (L = 1, 2, ...); groups
    whose prefix sorts before the group holding the need-th token are taken
    whole, and only that group is examined further.
    """
    chosen = []
    cond = F.lit(True)
    length = 0
    while n_ties > take_rows and need > 0:
        length += 1
        prefix = F.substring("token", 1, length)
        groups = (ties.filter(cond).groupBy(prefix.alias("p"))
                  .agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect())
        before = 0
        for g in groups:
            if before + g["n"] >= need:
                if before:
                    chosen.append(ties.filter(cond & (prefix < g["p"])))
                cond = cond & (prefix == g["p"])
                need, n_ties = need - before, g["n"]
                break
            before += g["n"]
    chosen.append(ties.filter(cond).orderBy("token").limit(need))
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out


_DRAWS = 1 << 17  # draws that one NumPy step holds


def _drawn_rows(vocab_size: int, config: ModelConfig):
    dim = config.embedding_dim
    scale = math.sqrt(6.0 / (vocab_size + dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _DRAWS // dim)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                idx = batch.column(0).slice(lo, step)
                n = len(idx)
                prefixes = [f"{config.random_seed}|proj|{i}|".encode() for i in idx.to_pylist()]
                words = md5_words(*keyed(prefixes, np.repeat(np.arange(n), dim), np.tile(np.arange(dim), n)))
                if config.use_orthogonal_init:
                    v = draws.normal_array(words).reshape(n, dim)
                    size = np.sqrt(np.einsum("ij,ij->i", v, v))
                    v = np.where((size > PROJECTION_ROW_EPS)[:, None], v / np.maximum(size, PROJECTION_ROW_EPS)[:, None], v)
                else:
                    v = -scale + 2 * scale * draws.uniform_array(words).reshape(n, dim)
                offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([idx, pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=["idx", "vec"])
    return run


def projection_rows(vocab_idx: DataFrame, vocab_size: int, config: ModelConfig) -> DataFrame:
    """One hash-drawn row per vocabulary index, drawn by array operations where the index lies.

    Gaussian rows are scaled to unit length when their norm exceeds 1e-8
    (the reference's "orthogonal" init only normalizes); otherwise Xavier
    uniform on +-sqrt(6 / (V + dim)).
    """
    return vocab_idx.select("idx").mapInArrow(_drawn_rows(vocab_size, config), "idx int, vec array<double>")


def train(corpus: DataFrame, config: ModelConfig | None = None,
          path: str | None = None, prune_bytes: int = PRUNE_BYTES) -> Model:
    """Train on a (doc_id, text) corpus; the model tables are written once.

    A corpus that the optimizer estimates at more than ``prune_bytes`` is counted by
    ``frequent_stats``, which reads it twice to keep rare tokens out of the shuffle. Both
    ways give the same model.
    """
    from bowline.sources import model_io

    config = config or ModelConfig()
    prune = estimated_bytes(corpus) > prune_bytes
    counted = frequent_stats(corpus, config) if prune else token_stats(corpus, config.use_ngrams)
    stats = materialize(counted, "token-stats")
    marker = stats.filter(F.col("token").isNull()).select("doc_freq").collect()
    n_docs = int(marker[0][0]) if marker else 0
    vocab = select_vocabulary(stats, n_docs, config)
    return model_io.write_model(corpus.sparkSession, vocab, config, n_docs, path)
