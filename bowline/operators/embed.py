"""Embedding documents.

Texts are normalized in the JVM; a ``mapInArrow`` step then finds their tokens
on the buffer, looks tokens and pairs of tokens up in a broadcast block of the
vocabulary, applies the BM25-like weight and sums weighted projection rows with
NumPy (with dropout, whose draws are JVM expressions, it gets term bags). A model that fits
``Limits.broadcast_bytes`` is one block. A larger one is cut into blocks of
vocabulary rows that each fit; the step tokenizes a run of rows once and goes
through the blocks, each adding its share to the rows' vectors. The step is
narrow: no shuffle, one Python worker a task whatever the number of blocks,
rows are never joined back on an id, and the blocks do not change the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from bowline.config import DEFAULT_LIMITS, Limits, clamp_dropout
from bowline.functions import draws
from bowline.functions.bitfilter import empty_filter, passes, put
from bowline.functions.text import BM25_K1, normalize
from bowline.functions.tokens import Vocabulary, token_runs
from bowline.functions.vectors import NORMALIZE_EPS
from bowline.operators.sums import vector_sums
from bowline.operators.train import Model, term_bags
from bowline.session import materialize

EMBEDDING = "embedding"


def weight(tf, n_terms, idf):
    """(k1 + 1) * nf / (k1 + nf) * idf with nf = tf / n_terms.

    The reference's length term ``k1 * (1 - b + b)`` cancels to k1, so no
    document-length normalization remains. Works on Columns and on NumPy.
    """
    nf = tf / n_terms
    return (BM25_K1 + 1.0) * nf / (BM25_K1 + nf) * idf


def bags_for(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    corpus = docs.select(F.col(id_col).alias("doc_id"), *(carry or []),
                         F.col(text_col).alias("text"))
    return term_bags(corpus, model.config.use_ngrams)


def term_frequency(docs: DataFrame, model: Model, id_col: str = "doc_id",
                   text_col: str = "text", limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(doc_id, idx, token, tf, n_terms, idf) for in-vocabulary terms.

    ``n_terms`` counts every term of the document, unknown ones and bigrams
    included. A vocabulary that fits the limit is sent to the texts, whose terms
    are counted on their codes; a larger one is joined to the terms.
    """
    if vocabulary_bytes(model) <= limits.broadcast_bytes:
        kind = docs.schema[id_col].dataType
        schema = Ty.StructType([Ty.StructField("doc_id", kind), *[Ty.StructField(c, t) for c, t in (
            ("idx", Ty.IntegerType()), ("token", Ty.StringType()), ("tf", Ty.IntegerType()),
            ("n_terms", Ty.IntegerType()), ("idf", Ty.DoubleType()))]])
        rows = docs.select(F.col(id_col).alias("doc_id"), normalize(F.col(text_col)).alias(_TERMS))
        return rows.mapInArrow(_frequencies(_vocabulary_block(model), model.config.use_ngrams), schema)
    vocab = model.vocabulary.select("token", "idx", "idf")
    return (bags_for(docs, model, id_col, text_col)
            .select("doc_id", "n_terms", F.explode("bag").alias("e"))
            .select("doc_id", "n_terms", F.col("e.token").alias("token"),
                    F.col("e.tf").alias("tf"))
            .join(vocab, "token").select("doc_id", "idx", "token", "tf", "n_terms", "idf"))


def _vocabulary_block(model: Model):
    """The broadcast vocabulary without its projection; kept on the model while its session lives."""
    sc = model.vocabulary.sparkSession.sparkContext
    held = model.broadcasts.get("vocabulary")
    if held is None or held[0] is not sc:
        vocab = model.vocabulary.select("idx", "token", "idf").orderBy("idx").toArrow()
        block = {"tokens": vocab.column("token").to_pylist(), "index": vocab.column("idx").to_numpy().astype(np.int32),
                 "idf": vocab.column("idf").to_numpy().astype(np.float64)}
        held = model.broadcasts["vocabulary"] = (sc, sc.broadcast(block))
    return held[1]


def _n_terms(t, use_ngrams: bool) -> np.ndarray:
    n = np.bincount(t.row, minlength=t.rows)
    return n + np.maximum(n - 1, 0) if use_ngrams else n


def _frequencies(bc, use_ngrams: bool):
    """Normalized text -> a row for each of its terms in the vocabulary, run by run."""
    def run(batches):
        block = bc.value
        vocab, v, names = _vocabulary(block), max(1, len(block["tokens"])), pa.array(block["tokens"], pa.string())
        for batch in batches:
            for t in token_runs(batch.column(1)):
                row, index = vocab.find(t, use_ngrams)
                key, tf = np.unique(row * v + index, return_counts=True)
                r, ix = key // v, key % v
                n_terms = _n_terms(t, use_ngrams)
                for a in range(0, len(r), _BATCH_TERMS):
                    rr, at = r[a:a + _BATCH_TERMS], ix[a:a + _BATCH_TERMS]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(t.first_row + rr)), pa.array(block["index"][at]), names.take(pa.array(at)),
                         pa.array(tf[a:a + _BATCH_TERMS].astype(np.int32)), pa.array(n_terms[rr].astype(np.int32)),
                         pa.array(block["idf"][at])], names=["doc_id", "idx", "token", "tf", "n_terms", "idf"])
    return run


def bm25_weights(docs: DataFrame, model: Model, id_col: str = "doc_id",
                 text_col: str = "text", dropout_rate: float = 0.0,
                 dropout_seed: int | None = None, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """E2 (+ E4): (doc_id, idx, weight); dropped terms removed, kept ones rescaled."""
    tf = term_frequency(docs, model, id_col, text_col, limits)
    w = weight(F.col("tf").cast("double"), F.col("n_terms").cast("double"), F.col("idf"))
    p = clamp_dropout(dropout_rate)
    if p > 0.0:
        seed = model.config.random_seed if dropout_seed is None else dropout_seed
        keep = draws.uniform(draws.key(seed, "drop", F.col("doc_id"), F.col("token"))) >= p
        tf = tf.filter(keep)
        w = w / (1.0 - p)
    return tf.select("doc_id", "idx", w.alias("weight"))


def _maybe_broadcast(df: DataFrame, size_bytes: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    return F.broadcast(df) if size_bytes <= limits.broadcast_bytes else df


def vocabulary_bytes(model: Model) -> int:
    """Counted size of the vocabulary: the tokens' bytes and a row's overhead."""
    if model.token_bytes is None:
        model.token_bytes = model.vocabulary.agg(
            F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()[0]
    return model.token_bytes + model.vocab_size * 48


def model_bytes(model: Model) -> int:
    return vocabulary_bytes(model) + model.vocab_size * model.embedding_dim * 8


def vocab_lookup(tokens: DataFrame, model: Model, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """V9 + V10: index and IDF of every row's ``token`` (NULL and 0.0 for unknown ones)."""
    vocab = _maybe_broadcast(model.vocabulary.select("token", "idx", "idf"), vocabulary_bytes(model), limits)
    return tokens.join(vocab, "token", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))


def embed(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          dropout_rate: float = 0.0, dropout_seed: int | None = None,
          limits: Limits = DEFAULT_LIMITS, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, embedding ARRAY<DOUBLE>) for every input row.

    Texts without tokens or with only unknown tokens embed to the zero
    vector; repeated and NULL ids are rows of their own. ``dropout_rate`` > 0
    drops each (document, term) with a seeded hash draw and rescales the kept
    ones by 1 / (1 - p) (E4). ``carry`` columns are passed through next to
    the id.
    """
    carry = carry or []
    p = clamp_dropout(dropout_rate)
    if p == 0.0:
        # no dropout: the Arrow step tokenizes and counts term frequencies itself
        rows = docs.select(F.col(id_col).alias("doc_id"), *carry, normalize(F.col(text_col)).alias(_TERMS))
    else:
        seed = model.config.random_seed if dropout_seed is None else dropout_seed
        rows = bags_for(docs, model, id_col, text_col, carry).withColumn(
            "bag", F.transform("bag", lambda e: F.struct(
                e["token"].alias("token"), e["tf"].alias("tf"),
                (draws.uniform(draws.key(seed, "drop", F.col("doc_id"), e["token"])) >= p)
                .alias("keep"))))
        rows = rows.select("doc_id", *carry, F.struct("bag", "n_terms").alias(_TERMS))
    vector = Ty.ArrayType(Ty.DoubleType(), False)
    head = [Ty.StructField("doc_id", docs.schema[id_col].dataType)] + [docs.schema[c] for c in carry]
    blocks, dim, chunk = broadcast_blocks(model, limits), model.embedding_dim, limits.projection_chunk
    fn = (_make_projector(blocks, dim, chunk, model.config.use_ngrams) if p == 0.0
          else _make_bag_projector(blocks, dim, p, chunk))
    rows = rows.mapInArrow(fn, Ty.StructType(head + [Ty.StructField(EMBEDDING, vector)]))
    return rows.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else rows


_TERMS = "_terms"
_BATCH_TERMS = 1 << 18  # terms that one NumPy step holds


# ---- the model in blocks -----------------------------------------------------

def _collect_block(model: Model, lo: int, hi: int) -> dict:
    """Vocabulary rows lo..hi-1 as NumPy arrays; the caller bounds their size."""
    inside = (F.col("idx") >= lo) & (F.col("idx") < hi)
    vocab = model.vocabulary.filter(inside).select("idx", "token", "idf").orderBy("idx").toArrow()
    proj = model.projection.filter(inside).select("idx", "vec").orderBy("idx").toArrow()
    dim = model.embedding_dim
    vecs = proj.column("vec").combine_chunks()
    if len(vecs) and (vecs.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError("projection rows do not have embedding_dim entries")
    matrix = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    idx = vocab.column("idx").to_numpy()
    if not (np.array_equal(idx, np.arange(lo, lo + len(idx)))
            and np.array_equal(proj.column("idx").to_numpy(), idx)):
        raise ValueError("vocabulary indexes are not dense 0..V-1")
    return {"tokens": vocab.column("token").to_pylist(),
            "idf": vocab.column("idf").to_numpy().astype(np.float64), "matrix": matrix}


def broadcast_blocks(model: Model, limits: Limits = DEFAULT_LIMITS) -> list:
    """Broadcasts of the model, each within the limit; kept on the model while its session lives."""
    sc = model.vocabulary.sparkSession.sparkContext
    size = max(1, -(-model_bytes(model) // limits.broadcast_bytes))
    rows = max(1, -(-model.vocab_size // min(size, max(1, model.vocab_size))))
    held = model.broadcasts.get(rows)
    if held is None or held[0] is not sc:
        blocks = [sc.broadcast(_collect_block(model, lo, lo + rows))
                  for lo in range(0, max(1, model.vocab_size), rows)]
        held = model.broadcasts[rows] = (sc, blocks)
    return held[1]


_VOCABULARIES: dict[int, tuple] = {}  # a Python worker's look-up tables, by the block they are made of


def _vocabulary(block: dict) -> Vocabulary:
    held = _VOCABULARIES.get(id(block))
    if held is None or held[0] is not block:
        if len(_VOCABULARIES) > 64:
            _VOCABULARIES.clear()
        held = _VOCABULARIES[id(block)] = (block, Vocabulary(block["tokens"]))
    return held[1]


def _add(out: np.ndarray, r: np.ndarray, ix: np.ndarray, w: np.ndarray, matrix: np.ndarray, chunk: int) -> None:
    """Add weighted projection rows to their rows of ``out``; ``r`` is ascending.

    Row by row, so that a row's projection rows are summed while they lie in the cache.
    """
    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1])[:len(r)])
    for row, a, b in zip(r[starts].tolist(), starts.tolist(), np.append(starts[1:], len(r)).tolist()):
        for lo in range(a, b, chunk):
            hi = min(b, lo + chunk)
            out[row] += w[lo:hi] @ matrix[ix[lo:hi]]


def _unit(out: np.ndarray) -> np.ndarray:
    """Divide the rows by their norms, where these exceed NORMALIZE_EPS."""
    norms = np.sqrt(np.einsum("ij,ij->i", out, out))
    big = norms > NORMALIZE_EPS
    out[big] /= norms[big, None]
    return out


def _finished(batch: pa.RecordBatch, out: np.ndarray) -> pa.RecordBatch:
    n, dim = out.shape
    out = _unit(out)
    names = batch.schema.names
    emb = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(out.ravel()))
    kept = [c for c in names if c != _TERMS]
    return pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in kept] + [emb], names=kept + [EMBEDDING])


def project_run(t, blocks: list, dim: int, chunk: int, use_ngrams: bool) -> np.ndarray:
    """Weighted sums of the tokens of a run of texts over the model's blocks, one row a text."""
    out = np.zeros((t.rows, dim))
    n_terms = _n_terms(t, use_ngrams).astype(np.float64)
    for bc in blocks:
        block = bc.value
        v = max(1, len(block["tokens"]))
        row, index = _vocabulary(block).find(t, use_ngrams)
        key, tf = np.unique(row * v + index, return_counts=True)  # (row, index) pairs, by one sort
        r, ix = key // v, key % v
        _add(out, r, ix, weight(tf.astype(np.float64), n_terms[r], block["idf"][ix]), block["matrix"], chunk)
    return out


def text_embedder(model: Model, limits: Limits = DEFAULT_LIMITS):
    """A function for Arrow steps: a column of normalized texts -> their vectors, as ``embed`` makes them."""
    blocks, dim, chunk, use_ngrams = broadcast_blocks(model, limits), model.embedding_dim, limits.projection_chunk, model.config.use_ngrams

    def vectors_of(texts: pa.Array) -> np.ndarray:
        return np.concatenate([np.zeros((0, dim)), *(
            _unit(project_run(t, blocks, dim, chunk, use_ngrams)) for t in token_runs(texts))])
    return vectors_of


def _make_projector(blocks, dim: int, chunk: int, use_ngrams: bool, *_):
    """Arrow batch function: normalized text -> sum over the vocabulary (one block or a list of them), normalized."""
    blocks = blocks if isinstance(blocks, list) else [blocks]

    def project(batches):
        for batch in batches:
            for t in token_runs(batch.column(batch.schema.get_field_index(_TERMS))):
                yield _finished(batch.slice(t.first_row, t.rows), project_run(t, blocks, dim, chunk, use_ngrams))
    return project


def _make_bag_projector(blocks: list, dim: int, p: float, chunk: int):
    """As ``_make_projector`` for bags of terms with a keep flag each, runs of rows with a bounded number of terms."""
    def project(batches):
        vocabs = [pa.array(bc.value["tokens"], type=pa.string()) for bc in blocks]
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(_TERMS)).field("bag")
            ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:  # a longer row stands alone
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + _BATCH_TERMS, "right")))
                part = batch.slice(lo, hi - lo)
                out = np.zeros((hi - lo, dim))
                for vocab, bc in zip(vocabs, blocks):
                    _add_bags(out, part, vocab, bc.value, p, chunk)
                yield _finished(part, out)
                lo = hi
    return project


def _add_bags(out, batch, vocab, block, p, chunk):
    bag, n_terms = batch.column(batch.schema.get_field_index(_TERMS)).flatten()
    flat = bag.flatten()
    if len(flat) and len(vocab):
        lengths = pc.fill_null(bag.value_lengths(), 0).to_numpy(zero_copy_only=False)
        n_terms = n_terms.to_numpy(zero_copy_only=False).astype(np.float64)
        idx = pc.index_in(flat.field("token"), value_set=vocab)
        sel = idx.is_valid().to_numpy(zero_copy_only=False)
        r = np.repeat(np.arange(len(out)), lengths)[sel]
        ix = idx.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        w = weight(flat.field("tf").to_numpy(zero_copy_only=False)[sel].astype(np.float64), n_terms[r], block["idf"][ix])
        keep = flat.field("keep").to_numpy(zero_copy_only=False)[sel]
        _add(out, r, ix, np.where(keep, w / (1.0 - p), 0.0), block["matrix"], chunk)


# ---- E3 as a table -------------------------------------------------------------

HOT_SHARE = 2  # an index is hot when it has more than 1 / (HOT_SHARE * partitions) of the weights
DOCS = 8192    # documents whose sums a task keeps
ROWS = 1024    # projection rows that a task keeps


def project_sums(weights: DataFrame, model: Model, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(doc_id, dim, value), the sum of weight x projection row per document.

    A projection that fits the limit is sent to the weights. Of a larger one the rows of hot indexes (at
    most HOT_SHARE times the partitions, by their definition) are sent; the other weights are packed by
    document and run of ROWS indexes where they lie, and meet the projection rows of their run in blocks
    of about DOCS documents. A task keeps the sums of one block and one run of rows, so a weight never
    carries a vector and a document gives one vector to the last sum for each way.
    """
    spark = weights.sparkSession
    if model.vocab_size * model.embedding_dim * 8 <= limits.broadcast_bytes:
        parts = _sent_sums(weights, model.projection)
    else:
        weights = materialize(weights.select("doc_id", "idx", "weight"), "weights")
        counts = materialize(weights.groupBy("idx").agg(F.count(F.lit(1)).alias("n")), "index-counts")
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        hot = F.broadcast(counts.filter(F.col("n") * (HOT_SHARE * shares) > total).select("idx"))
        parts = _sent_sums(weights.join(hot, "idx", "left_semi").select("doc_id", "idx", "weight"),
                           model.projection.join(hot, "idx", "left_semi"))
        parts = parts.unionByName(_met_sums(weights.join(hot, "idx", "left_anti"), model.projection.join(hot, "idx", "left_anti")))
    return vector_sums(parts, "doc_id", "v").withColumnRenamed("x", "value")


def _sums_schema(weights: DataFrame) -> Ty.StructType:
    return Ty.StructType([Ty.StructField("doc_id", weights.schema["doc_id"].dataType),
                          Ty.StructField("v", Ty.ArrayType(Ty.DoubleType()))])


def _sum_rows(ids: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], names=["doc_id", "v"])


def _sent_sums(weights: DataFrame, projection: DataFrame) -> DataFrame:
    """(doc_id, v): sums of a batch's weights with the projection rows, which are sent to them."""
    rows = projection.select("idx", "vec").orderBy("idx").toArrow()
    index = rows.column("idx").to_numpy()
    flat = rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    bc = weights.sparkSession.sparkContext.broadcast((index, flat.reshape(len(index), -1) if len(index) else None))

    def run(batches):
        known, matrix = bc.value
        for batch in batches:
            if not batch.num_rows or matrix is None:
                continue
            at = np.minimum(np.searchsorted(known, batch.column(1).to_numpy()), len(known) - 1)
            on = np.flatnonzero(known[at] == batch.column(1).to_numpy())
            if not len(on):
                continue
            ids = batch.column(0).take(pa.array(on)).dictionary_encode(null_encoding="encode")
            code = ids.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            sums = np.zeros((len(ids.dictionary), matrix.shape[1]))
            w = batch.column(2).to_numpy(zero_copy_only=False)[on]
            _add(sums, code[order], at[on][order], w[order], matrix, DEFAULT_LIMITS.projection_chunk)
            yield _sum_rows(ids.dictionary, sums)
    return weights.select("doc_id", "idx", F.col("weight").cast("double")).mapInArrow(run, _sums_schema(weights))


def _packed_weights(batches):
    """(doc_id, idx, weight) -> (doc_id, run, idx list, weight list) of every batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).dictionary_encode(null_encoding="encode")
        code, idx = ids.indices.to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int32)
        order = np.lexsort((idx // ROWS, code))
        code, idx, w = code[order], idx[order], batch.column(2).to_numpy(zero_copy_only=False)[order]
        new = np.append(True, (code[1:] != code[:-1]) | (idx[1:] // ROWS != idx[:-1] // ROWS))
        starts = np.flatnonzero(new)
        ends = pa.array(np.append(starts, len(code)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [ids.dictionary.take(pa.array(code[starts])), pa.array((idx[starts] // ROWS).astype(np.int32)),
             pa.ListArray.from_arrays(ends, pa.array(idx)), pa.ListArray.from_arrays(ends, pa.array(w))],
            names=["doc_id", "run", "ids", "ws"])


def _met_sums(weights: DataFrame, projection: DataFrame) -> DataFrame:
    """(doc_id, v): the sums of every document, by blocks of documents and runs of projection rows."""
    kind = weights.schema["doc_id"].dataType.simpleString()
    packed = materialize(weights.select("doc_id", "idx", F.col("weight").cast("double").alias("weight")).mapInArrow(
        _packed_weights, f"doc_id {kind}, run int, ids array<int>, ws array<double>"), "packed-weights")
    blocks = max(1, -(-packed.select("doc_id").distinct().count() // DOCS))
    packed = packed.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    # a run's rows go to the blocks that have weights in it, at most one place a block
    needed = F.broadcast(packed.select("block", "run").distinct())
    rows = projection.withColumn("run", F.floor(F.col("idx") / ROWS).cast("int")).join(needed, "run").select(
        "block", "run", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"),
        F.array("idx").alias("ids"), F.col("vec").cast("array<double>").alias("ws"))
    given = packed.select("block", "run", F.lit(1).alias("kind"), "doc_id", "ids", "ws")
    return (rows.unionByName(given).repartition("block").sortWithinPartitions("block", "run", "kind")
            .mapInArrow(_block_sums, _sums_schema(weights)))


def _block_sums(batches):
    """Rows by block, run and kind, projection rows (kind 0) before weights: one vector per document of a block."""
    block = run = ids = sums = None
    vecs, index, matrix = [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
            if keys[0, a] != block:
                if ids is not None:
                    yield from _slices(ids, sums)
                block, run, ids, sums = keys[0, a], None, None, None
            if keys[1, a] != run:
                run, vecs, index, matrix = keys[1, a], [], [], None
            lists, values = batch.column(4).slice(a, b - a), batch.column(5).slice(a, b - a)
            at, x = lists.flatten().to_numpy(), values.flatten().to_numpy(zero_copy_only=False)
            if keys[2, a] == 0:
                index.append(at)
                vecs.append(x.reshape(b - a, -1))
                continue
            if matrix is None:
                place = np.concatenate(index)
                order = np.argsort(place)
                place, matrix = place[order], np.concatenate(vecs)[order]
            named = batch.column(3).slice(a, b - a)
            if ids is None:
                ids, sums = named.unique(), np.zeros((0, matrix.shape[1]))
            row = pc.index_in(named, value_set=ids)
            if row.null_count:
                ids = pa.concat_arrays([ids, named.filter(row.is_null()).unique()])
                row = pc.index_in(named, value_set=ids)
            if len(sums) < len(ids):
                sums = np.concatenate([sums, np.zeros((max(len(ids), 2 * len(sums)) - len(sums), matrix.shape[1]))])
            of = np.repeat(row.to_numpy().astype(np.int64), lists.value_lengths().to_numpy())
            order = np.argsort(of, kind="stable")
            _add(sums, of[order], np.searchsorted(place, at)[order], x[order], matrix, DEFAULT_LIMITS.projection_chunk)
    if ids is not None:
        yield from _slices(ids, sums)


def _slices(ids: pa.Array, sums: np.ndarray):
    for a in range(0, len(ids), ROWS):
        b = min(a + ROWS, len(ids))
        yield _sum_rows(ids.slice(a, b - a), sums[a:b])


# ---- E8: embedding store -------------------------------------------------------

DIGEST_ROW = 96  # bytes of one digest and id in a hashed relation


def text_digest(text: Column) -> Column:
    """What a text is looked up by: 128 bits of MD5, 64 of XXH64 and the length; NULL for NULL."""
    return F.when(text.isNotNull(), F.struct(F.unhex(F.md5(text)).alias("md5"), F.xxhash64(text).alias("xx"),
                                             F.octet_length(text).alias("n")))


def _may_hold(keys: DataFrame, limits: Limits):
    """A filter over 64-bit keys as an Arrow function; a bounded size, so more keys let more others pass."""
    rows = keys.count()
    blocks = max(1, -(-rows * 8 // limits.broadcast_bytes))
    bits = empty_filter(rows, limits.broadcast_bytes)
    for i in range(blocks):  # the driver holds one block of keys at a time
        part = keys if blocks == 1 else keys.filter(F.shiftrightunsigned("h", 33) % blocks == i)
        put(bits, part.toArrow().column("h").to_numpy().view(np.uint64))
    bc = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf(Ty.BooleanType())
    def may(h: pa.Array) -> pa.Array:
        return pa.array(passes(bc.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))
    return may


def embed_with_store(docs: DataFrame, store: DataFrame, model: Model, id_col: str = "doc_id",
                     text_col: str = "text", capacity: int | None = None,
                     limits: Limits = DEFAULT_LIMITS) -> tuple[DataFrame, DataFrame]:
    """Reuse stored vectors of identical texts, embed each unseen text once.

    ``store`` is (text, embedding); where it holds a text more than once, the
    smallest vector counts. Returns (id, embedding) for every input row and
    the grown store: unseen texts are added, by default all of them; with a
    ``capacity``, smallest id first until the store holds that many entries.

    Texts are looked up by ``text_digest`` and do not move: rows and store
    meet by digest, and an unseen text is embedded where its row with the
    smallest id lies. These rows are named by id and digest. If their counted
    size allows, they are sent to the texts; else a bit filter of a bounded
    size is, and only the few texts that pass it meet the exact list.
    """
    d = docs.select(F.col(id_col), F.col(text_col).alias("_t"), text_digest(F.col(text_col)).alias("_d"))
    st = store.groupBy(text_digest(F.col("text")).alias("_d")).agg(F.min(EMBEDDING).alias(EMBEDDING))
    keys = materialize(d.select(id_col, "_d"), "digests")
    unseen = materialize(keys.filter(F.col("_d").isNotNull()).groupBy("_d").agg(F.min(id_col).alias("_first"))
                         .join(st.select("_d"), "_d", "left_anti"), "unseen")
    n = unseen.count()
    named = unseen.select(F.col("_d").alias("_ud"), "_first")
    same = (F.col("_d") == F.col("_ud")) & F.col(id_col).eqNullSafe(F.col("_first"))
    if n * DIGEST_ROW <= limits.broadcast_bytes:
        rows = d.join(F.broadcast(named), same, "left_semi")
    else:
        def key(ident: str, digest: str) -> Column:
            return F.xxhash64(F.col(ident), F.col(f"{digest}.xx"))
        may = _may_hold(unseen.select(key("_first", "_d").alias("h")), limits)
        rows = d.filter(F.col("_d").isNotNull()).filter(may(key(id_col, "_d"))).join(named, same, "left_semi")
    rows = rows.select(F.col(id_col).alias("_first"), "_t", "_d")
    fresh = materialize(embed(rows, model, "_first", "_t", limits=limits, carry=["_t", "_d"]), "fresh")
    if fresh.count() > n:  # rows that repeat both id and text
        fresh = fresh.dropDuplicates(["_d"])
    known = st.unionByName(fresh.select("_d", EMBEDDING))
    zero = F.array_repeat(F.lit(0.0), model.embedding_dim)
    out = keys.join(known, "_d", "left").select(id_col, F.coalesce(EMBEDDING, zero).alias(EMBEDDING))
    added = fresh
    if capacity is not None:
        added = fresh.orderBy("_first", "_t").limit(max(0, capacity - store.count()))
    return out, store.select("text", EMBEDDING).unionByName(added.select(F.col("_t").alias("text"), EMBEDDING))
