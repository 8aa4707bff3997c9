import math

import numpy as np
import pytest

from bowline.config import Limits, ModelConfig
from bowline.operators.embed import bm25_weights, embed, model_bytes
from bowline.operators.train import train
from bowline.session import work_path
from bowline.sources import model_io

CORPUS = ["test document one", "test document two", "completely different content"]


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    m = train(docs, ModelConfig(embedding_dim=8, min_token_frequency=1))
    return docs, m


def test_vocabulary_golden(small):
    _, m = small
    v = {r["token"]: r for r in m.vocabulary.collect()}
    assert len(v) == 12 and m.n_docs == 3
    for t in ("test", "document", "test_document"):
        assert v[t]["token_count"] == 2 and v[t]["doc_freq"] == 2
        assert abs(v[t]["idf"] - math.log(4 / 2.5)) < 1e-12
    assert abs(v["one"]["idf"] - 0.980829) < 1e-6
    assert [r["idx"] for r in m.vocabulary.orderBy("idx").collect()] == list(range(12))


def test_weights_golden(spark, small):
    docs, m = small
    w = {(r["doc_id"], r["idx"]): r["weight"] for r in bm25_weights(docs, m).collect()}
    idx = {r["token"]: r["idx"] for r in m.vocabulary.collect()}
    assert abs(w[(0, idx["test"])] - 0.147716) < 1e-6
    assert abs(w[(0, idx["one"])] - 0.308261) < 1e-6


def test_embed_strategies_agree_and_dims(spark, small):
    docs, m = small
    extra = spark.createDataFrame([(10, ""), (11, "unknownword zzz"), (12, "test document")],
                                  "doc_id long, text string")
    d = docs.unionByName(extra)
    blocks = Limits(broadcast_bytes=model_bytes(m) // 4)
    a = {r["doc_id"]: np.array(r["embedding"]) for r in embed(d, m).collect()}
    b = {r["doc_id"]: np.array(r["embedding"]) for r in embed(d, m, limits=blocks).collect()}
    assert set(a) == set(b) == {0, 1, 2, 10, 11, 12}
    for k in a:
        assert a[k].shape == (8,)
        assert np.allclose(a[k], b[k], atol=1e-12)
    assert not a[10].any() and not a[11].any()          # no tokens / unknown tokens -> zeros
    assert abs(np.linalg.norm(a[0]) - 1.0) < 1e-12
    # dropout 0 is deterministic; seeded dropout agrees across strategies
    c = {r["doc_id"]: np.array(r["embedding"]) for r in embed(d.repartition(3), m).collect()}
    assert all(np.allclose(a[k], c[k], atol=1e-12) for k in a)
    p = {r["doc_id"]: np.array(r["embedding"]) for r in embed(d, m, dropout_rate=0.5).collect()}
    q = {r["doc_id"]: np.array(r["embedding"]) for r in embed(d, m, dropout_rate=0.5, limits=blocks).collect()}
    assert all(np.allclose(p[k], q[k], atol=1e-12) for k in p)


def test_save_load_roundtrip(spark, small):
    _, m = small
    path = work_path(spark, "test-model")
    model_io.save(m, path)
    back = model_io.load(spark, path)
    assert back.vocab_size == m.vocab_size == 12
    assert back.config == m.config
    assert sorted(back.vocabulary.collect()) == sorted(m.vocabulary.collect())


def test_default_config_empty_vocabulary(spark):
    docs = spark.createDataFrame([(0, "test save load")], "doc_id long, text string")
    m = train(docs, ModelConfig())
    assert m.vocab_size == 0
    e = embed(docs, m).collect()
    assert len(e) == 1 and not any(e[0]["embedding"])


def test_vocabulary_cut_with_many_ties(spark):
    import random
    from bowline.operators.train import select_vocabulary
    rnd = random.Random(13)
    alphabet = "abcé日"
    toks = set()
    while len(toks) < 300:
        toks.add("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 6))))
    toks = sorted(toks)
    rows = [(t, 5 if i < 20 else 2, 1) for i, t in enumerate(toks)]   # 20 above the cut, 280 tied
    stats = spark.createDataFrame(rows, "token string, token_count long, doc_freq long")
    for n_max, take in ((57, 3), (21, 1), (299, 5), (400, 2)):
        cfg = ModelConfig(max_vocabulary_size=n_max, min_token_frequency=1)
        got = [r["token"] for r in select_vocabulary(stats, 10, cfg, take_rows=take).orderBy("idx").collect()]
        above = sorted(t for t, c, _ in rows if c == 5)
        tied = sorted((t for t, c, _ in rows if c == 2), key=lambda t: t.encode())
        want = (sorted(above, key=lambda t: t.encode()) + tied)[:n_max]
        assert got == want, (n_max, take)


def test_blocks_keep_repeated_and_null_ids_apart(spark, small):
    _, m = small
    d = spark.createDataFrame([(1, "test document"), (1, "completely different"), (None, "content one")],
                              "doc_id long, text string")
    rows = [sorted((str(r["doc_id"]), np.round(r["embedding"], 9).tolist()) for r in embed(d, m, limits=limits).collect())
            for limits in (Limits(), Limits(broadcast_bytes=model_bytes(m) // 5))]
    assert rows[0] == rows[1] and len(rows[0]) == 3
    assert len({tuple(v) for _, v in rows[0]}) == 3 and all(any(v) for _, v in rows[0])


def test_long_rows_are_embedded_in_runs(spark, small, monkeypatch):
    """The projector in this process, over runs of any size: the vectors that the query gives."""
    import pyarrow as pa
    from bowline.config import DEFAULT_LIMITS
    from bowline.functions import grams, tokens
    from bowline.operators import embed as E
    _, m = small
    rows = [(i, "test document one " * (1 + i % 5) * 10) for i in range(40)] + [(40, None), (41, "")]
    want = {r["doc_id"]: r["embedding"] for r in embed(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    (block,) = E.broadcast_blocks(m, DEFAULT_LIMITS)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", E._TERMS])
    keep = grams.runs
    for limit in (1, 500, 1 << 20):
        monkeypatch.setattr(tokens, "runs", lambda c: keep(c, limit))
        out = list(E._make_projector(block, m.embedding_dim, 7, True, True, True)([batch]))
        assert len(out) > 1 or limit == 1 << 20
        got = {i: v for b in out for i, v in zip(*(c.to_pylist() for c in b.columns))}
        assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)


def test_one_model_per_broadcast(spark, small):
    docs, m = small
    other = train(docs, ModelConfig(embedding_dim=8, min_token_frequency=1, random_seed=7))
    a, b = ([r["embedding"] for r in embed(docs, x).orderBy("doc_id").collect()] for x in (m, other))
    assert a != b


@pytest.mark.parametrize("change", [{"use_ngrams": False}, {"use_orthogonal_init": False}])
def test_training_options(spark, change):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    m = train(docs, ModelConfig(embedding_dim=8, min_token_frequency=1).replace(**change))
    tokens = {r["token"] for r in m.vocabulary.collect()}
    assert ("test_document" in tokens) == m.config.use_ngrams and "document" in tokens
    rows = np.array([r["vec"] for r in m.projection.collect()])
    if m.config.use_orthogonal_init:
        assert np.allclose(np.linalg.norm(rows, axis=1), 1.0)
    else:
        assert np.abs(rows).max() <= math.sqrt(6.0 / (m.vocab_size + 8)) and rows.std() > 0.1
    e = np.array([r["embedding"] for r in embed(docs, m).collect()])
    assert np.allclose(np.linalg.norm(e, axis=1), 1.0)


def test_configuration():
    assert ModelConfig(projection_dropout=2.0).projection_dropout == 0.9
    assert ModelConfig.from_dict({**ModelConfig(embedding_dim=5).to_dict(), "unknown": 1}).embedding_dim == 5
    with pytest.raises(ValueError):
        ModelConfig(embedding_dim=0)
    with pytest.raises(ValueError):
        ModelConfig(max_vocabulary_size=-1)


def test_only_local_sessions_get_a_temporary_folder(tmp_path):
    from bowline import session
    assert session._temporary_folder("local[4]")
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session._temporary_folder(master)


def test_work_folders_are_released(spark):
    import os
    from bowline import session
    df = session.materialize(spark.range(3), "gone")
    path = next(p for p in session._MADE if "gone" in p)
    assert df.count() == 3
    held, session._MADE = session._MADE - {path}, {path}
    assert session.release_work(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    session._MADE |= held


def test_rare_tokens_of_a_corpus_of_some_size_stay_out_of_the_shuffle(spark, tmp_path, monkeypatch):
    """A model trained from Parquet over the default limit: rare pairs are never written, the vocabulary is the full one."""
    import random
    from bowline.operators import train as R
    from bowline.sources.corpus import read_corpus
    r = random.Random(5)
    words = [f"w{i:x}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(words, [1 / (j + 5) for j in range(3000)], k=2000)) + "x" * 4000) for i in range(600)]
    rows += [(600 + i, f"{r.getrandbits(40_000):x}") for i in range(5000)]  # bytes that do not compress
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    config = ModelConfig(embedding_dim=4, max_vocabulary_size=300)
    written, keep = {}, R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    docs = read_corpus(spark, f"{tmp_path}/d")
    small = train(docs, config)
    assert written["token-stats"].count() < 10_000
    full = keep(R.token_stats(docs), "full")
    assert full.count() > 100_000
    want = R.select_vocabulary(full, 5600, config)
    assert sorted(map(tuple, small.vocabulary.collect())) == sorted(map(tuple, want.collect())) and small.n_docs == 5600


def test_word_hashes_depend_on_the_bytes_alone():
    import pyarrow as pa
    from bowline.functions.tokens import word_hashes
    words = ["ab", "ba", "aab", "é", "日本", "ab", "a" * 300, ""]
    h = word_hashes(pa.array(words))
    assert len(set(h.tolist())) == 7 and h[0] == h[5]
    assert (word_hashes(pa.array(["zz", *words]).slice(1)) == h).all()


def test_blocks_are_one_step(spark, small):
    """A model in many blocks takes one Python worker a task, as a model of one block does."""
    docs, m = small
    for limits in (Limits(), Limits(broadcast_bytes=model_bytes(m) // 5)):
        for rate in (0.0, 0.2):
            plan = embed(docs, m, dropout_rate=rate, limits=limits)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("MapInArrow") == 1
    assert len(m.broadcasts) > 1


def test_grown_store_is_grouped_by_digest(spark, tmp_path):
    """The counts and vectors of every text, and no text in the exchange that groups them."""
    import hashlib
    from bowline.plans import catalog
    rows = [(i, t) for i, t in enumerate(["alpha beta", "gamma delta", "alpha beta", "Alpha beta", "delta", "gamma delta", "kilo"])] + [
        (0, "alpha beta"), (None, "lima"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["store_grown"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    (line,) = [x for x in plan.splitlines() if "Aggregate" in x and "copies" in x]
    assert "Aggregate [text" not in line and "md5" in line
    copies = {r["text_md5"]: r["copies"] for r in got.collect()}
    # held: ids 0 (three times with the added copy, and the repeated id's), 3, 6 and 9; the others are added once
    want = {"alpha beta": 4, "Alpha beta": 1, "kilo": 1, "gamma delta": 1, "delta": 1, "lima": 1}
    assert copies == {hashlib.md5(t.encode()).hexdigest(): n for t, n in want.items()}
