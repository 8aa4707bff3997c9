import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bowline.config import ModelConfig
from bowline.operators.embed import embed, embed_with_store
from bowline.operators.retrieval import retrieval_metrics, retrieval_per_query
from bowline.operators.search import recall_candidates
from bowline.operators.train import train


def test_recall_candidates_shape(spark):
    n = 137
    pos = spark.range(n).select(F.col("id").alias("pos"))
    rows = recall_candidates(n, pos).collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r["query_pos"], []).append((r["cand_pos"], r["is_positive"]))
    assert sorted(by_q) == [i for i in range(n) if i % 10 == 0 and i < n - 5]
    for q, cands in by_q.items():
        positives = [c for c, p in cands if p]
        negatives = [c for c, p in cands if not p]
        assert positives == [q + 1]
        assert len(negatives) == len(set(negatives)) and 17 <= len(negatives) <= 19
        assert all(0 <= c < n and c not in (q, q + 1) for c in negatives)


@pytest.mark.parametrize("n", [19, 30, 75, 76, 400])
def test_negatives_are_drawn_without_replacement(spark, n):
    rows = recall_candidates(n, spark.range(n).select(F.col("id").alias("pos"))).filter("not is_positive").collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r["query_pos"], []).append(r["cand_pos"])
    assert all(17 <= len(c) == len(set(c)) <= 19 for c in by_q.values())
    assert len({tuple(sorted(c)) for c in by_q.values()}) == len(by_q)
    few = recall_candidates(12, spark.range(12).select(F.col("id").alias("pos"))).filter("not is_positive").collect()
    assert sorted(r["cand_pos"] for r in few) == list(range(2, 12))


def test_no_results_for_k_zero_and_two_afterwards(spark):
    from bowline.operators.retrieval import evaluate_document_retrieval
    from bowline.operators.search import top_k_cosine
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "cand_id long, embedding array<double>")
    none = top_k_cosine(q, c, 0)
    two = top_k_cosine(q, c, 2)
    assert none.columns == two.columns and none.count() == 0
    assert [(r["rank"], r["cand_id"]) for r in two.orderBy("rank").collect()] == [(1, 5), (2, 6)]
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "gamma delta")], "doc_id long, text string")
    m = train(docs, ModelConfig(embedding_dim=6, min_token_frequency=1))
    qs = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    qrels = spark.createDataFrame([(1, 0)], "query_id long, doc_id long")
    assert evaluate_document_retrieval(qs, qrels, docs, m, 0).first()["precision_at_k"] == 0.0
    assert evaluate_document_retrieval(qs, qrels, docs, m, 1).first()["mean_reciprocal_rank"] == 1.0


def test_string_ids(spark):
    from bowline.operators.retrieval import evaluate_document_retrieval
    from bowline.operators.search import nearest_neighbors
    from bowline.operators.temporal import evaluate_temporal_ordering
    docs = spark.createDataFrame([("d2", "alpha beta"), ("d1", "alpha beta"), ("é", "gamma delta")], "doc_id string, text string")
    m = train(docs, ModelConfig(embedding_dim=6, min_token_frequency=1))
    q = spark.createDataFrame([("q", "alpha beta"), ("r", "delta gamma")], "query_id string, text string")
    got = nearest_neighbors(q, docs.repartition(3), m, 2).orderBy("query_id", "rank").collect()
    assert [r["cand_id"] for r in got if r["query_id"] == "q"] == ["d1", "d2"] and got[2]["cand_id"] == "é"
    qrels = spark.createDataFrame([("q", "d1")], "query_id string, doc_id string")
    assert evaluate_document_retrieval(q, qrels, docs, m, 1).first()["mean_reciprocal_rank"] == 0.5
    seqs = spark.createDataFrame([("s", i, t) for i, t in enumerate(["alpha", "beta", "gamma", "delta"])],
                                 "seq_id string, pos long, text string")
    assert evaluate_temporal_ordering(seqs, m).first()["average_distance"] > 0


def test_large_ids(spark):
    from bowline.operators.coherence import evaluate_semantic_coherence, text_pair_similarity
    from bowline.operators.search import analogy
    from bowline.operators.stability import variant_similarity
    docs = spark.createDataFrame([(2 ** 53 + 1, "alpha beta"), (2 ** 62 + 1, "gamma delta")], "doc_id long, text string")
    m = train(docs, ModelConfig(embedding_dim=6, min_token_frequency=1))
    ids = [2 ** 53 + 1, 2 ** 53 + 3, 2 ** 62, None]
    pairs = spark.createDataFrame([(i, "alpha", "alpha", True) for i in ids] + [(ids[0], "alpha", "gamma", False)],
                                  "pair_id long, word1 string, word2 string, related boolean")
    got = text_pair_similarity(pairs, m).collect()
    assert sorted(str(r["pair_id"]) for r in got) == sorted(str(i) for i in ids + ids[:1])
    assert all(abs(r["similarity"] - 1) < 1e-9 for r in got if r["related"])
    assert evaluate_semantic_coherence(pairs, m).first()["average_related_similarity"] > 0.99
    t = spark.createDataFrame([(i, "alpha", "alpha", "gamma delta") for i in ids[:3]], "analogy_id long, a string, b string, c string")
    assert {(r["query_id"], r["cand_id"]) for r in analogy(t, docs, m, 1).collect()} == {(i, 2 ** 62 + 1) for i in ids[:3]}
    sims = variant_similarity(docs, m, 2, 0.0).collect()
    assert len(sims) == 4 and all(abs(r["similarity"] - 1) < 1e-9 for r in sims)


def test_retrieval_formulas(spark):
    # query 1: hits at ranks 1 and 3 of 3 relevant; query 2: no hit; query 3: none listed
    ranking = spark.createDataFrame(
        [(1, 1, 10, 0.9, 1), (1, 2, 11, 0.8, 0), (1, 3, 12, 0.7, 1),
         (2, 1, 20, 0.5, 0), (2, 2, 21, 0.4, 0), (2, 3, 22, 0.3, 0),
         (3, 1, 30, 0.2, 0), (3, 2, 31, 0.1, 0), (3, 3, 32, 0.0, 0)],
        "query_id long, rank int, doc_id long, similarity double, is_rel int")
    qrels = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (2, 50)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    pq = {r["query_id"]: r for r in retrieval_per_query(ranking, queries, qrels, 3).collect()}
    assert pq[1]["found"] == 2 and abs(pq[1]["precision"] - 2 / 3) < 1e-12
    assert abs(pq[1]["recall"] - 2 / 3) < 1e-12
    assert abs(pq[1]["ap"] - (1 / 1 + 2 / 3) / 2) < 1e-12 and pq[1]["rr"] == 1.0
    assert pq[2]["found"] == 0 and pq[2]["ap"] == 0.0 and pq[2]["rr"] == 0.0 and pq[2]["recall"] == 0.0
    assert pq[3]["recall"] == 0.0
    m = retrieval_metrics(retrieval_per_query(ranking, queries, qrels, 3)).first()
    p, r = (2 / 3) / 3, (2 / 3) / 3
    assert abs(m["precision_at_k"] - p) < 1e-12 and abs(m["recall_at_k"] - r) < 1e-12
    assert abs(m["f1_score"] - 2 * p * r / (p + r)) < 1e-12
    assert abs(m["mean_reciprocal_rank"] - 1 / 3) < 1e-12


def test_embedding_store(spark):
    docs = spark.createDataFrame([(0, "alpha beta gamma"), (1, "beta gamma delta"), (2, "alpha beta gamma"),
                                  (3, "new words here"), (4, "new words here")], "doc_id long, text string")
    m = train(docs, ModelConfig(embedding_dim=6, min_token_frequency=1))
    stored = embed(docs.filter("doc_id = 0"), m).join(docs, "doc_id").select("text", "embedding")
    twice = stored.unionByName(stored)
    out, store = embed_with_store(docs, twice, m)
    assert out.count() == 5 and store.count() == 4               # a repeated stored text is one vector; no cap
    fake = stored.select("text", F.transform("embedding", lambda x: x * 0.0 + 7.0).alias("embedding"))
    out, store = embed_with_store(docs, fake, m, capacity=3)
    got = {r["doc_id"]: r["embedding"] for r in out.collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[0] == [7.0] * 6 and got[2] == [7.0] * 6          # stored vector reused
    fresh = {r["doc_id"]: r["embedding"] for r in embed(docs, m).collect()}
    assert np.allclose(got[1], fresh[1]) and np.allclose(got[3], fresh[3])
    texts = [r["text"] for r in store.collect()]
    assert len(texts) == 3 and "alpha beta gamma" in texts
    assert "beta gamma delta" in texts                           # smallest new id added first


def test_word_and_character_grams(spark):
    import pyarrow as pa
    from bowline.functions import grams
    r = random.Random(6)
    space = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    letters = "ab\u00e9\u0105\u200b\u3001\U0001f642\u00c2\u1681\u2010\u2060\u00a1"
    texts = ["".join(r.choice(space) if r.random() < 0.3 else r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(400)]
    texts += [None, "", "x", space]
    column = pa.array(texts)
    seen_words, seen_chars = {}, {}
    for limit in (1, 50, 1 << 20):
        for run in grams.runs(column, limit):
            w = grams.words(run)
            split = [re.findall(f"[^{space}]+", t or "") for t in texts[run.row:run.row + len(run.offs) - 1]]
            assert np.diff(w.first).tolist() == [len(x) for x in split]
            flat = [x for ws in split for x in ws]
            for n in (1, 2, 4):
                at, h = grams.word_grams(w, n)
                want = [tuple(ws[i:i + n]) for ws in split for i in range(len(ws) - n + 1)]
                assert [tuple(flat[i:i + n]) for i in at] == want
                for gram, key in zip(want, h.tolist()):
                    assert seen_words.setdefault(gram, key) == key
                row, h = grams.char_grams(run, n)
                chars = [(k, t[i:i + n]) for k, t in enumerate(texts[run.row:run.row + len(run.offs) - 1])
                         for i in range(len(t or "") - n + 1)]
                assert row.tolist() == [k for k, _ in chars]
                for (_, gram), key in zip(chars, h.tolist()):
                    assert seen_chars.setdefault(gram, key) == key
    for seen in (seen_words, seen_chars):
        assert len(set(seen.values())) == len(seen)


def test_passage_hits_do_not_grow_with_the_text(spark):
    """Only documents that hold a passage's key emit rows, whatever else they hold; blocks change nothing."""
    from bowline.config import Limits
    from bowline.functions.bitfilter import bit_filter, passes
    from bowline.operators.retrieval import passage_qrels
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(4000)]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 120)))) for i in range(300)]
    passages = [(q, " ".join(docs[q * 3][1].split()[1:r.randint(3, 9)])) for q in range(80)] + [(100, "v1"), (101, "9 v"), (102, None)]
    want = {(q, i) for q, t in passages if t for i, d in docs if t in d}
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    pdf = spark.createDataFrame(passages, "item_id long, text string")
    for limits in (Limits(), Limits(broadcast_bytes=512)):
        assert {(x["query_id"], x["doc_id"]) for x in passage_qrels(pdf, ddf, limits=limits).collect()} == want
    keys = np.array([r.getrandbits(64) for _ in range(5000)], np.uint64)
    others = np.array([r.getrandbits(64) for _ in range(50_000)], np.uint64)
    bits = bit_filter(keys)
    assert passes(bits, keys).all() and passes(bits, others).mean() < 0.08


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_store_by_digest_moves_no_text(spark, monkeypatch):
    """Both ways of naming unseen rows agree with embedding everything; hot, null and repeated rows."""
    from bowline.config import Limits
    from bowline.operators import embed as E
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = [(i, r.choice(texts)) for i in range(300)] + [(1000 + i, "hot text") for i in range(200)]
    rows += [(5, rows[5][1]), (5, "another text of one id"), (None, "no id"), (None, "no id"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    m = train(docs.filter("text is not null"), ModelConfig(embedding_dim=5, min_token_frequency=1))
    held = docs.filter("doc_id % 4 = 0 and text is not null").dropDuplicates(["text"])
    stored = spark.createDataFrame([(t, e) for t, e in zip(
        [x["text"] for x in held.orderBy("text").collect()], [[float(k)] * 5 for k in range(400)])], "text string, embedding array<double>")
    vectors = {x["text"]: x["embedding"] for x in stored.collect()}
    plain = {t: x for (t,), x in zip([(t,) for _, t in rows], [None] * len(rows))}
    texts_of = docs.filter("text is not null").select("text").distinct()
    for x in embed(texts_of.withColumn("doc_id", F.lit(1)), m, carry=["text"]).collect():
        plain[x["text"]] = vectors.get(x["text"], x["embedding"])
    plain[None] = [0.0] * 5
    moved = []
    keep = E.materialize
    monkeypatch.setattr(E, "materialize", lambda df, name: (moved.extend((name, e) for e in exchanges(df)), keep(df, name))[1])
    for limits in (Limits(), Limits(broadcast_bytes=1000)):
        out, grown = embed_with_store(docs, stored, m, limits=limits)
        got = sorted((str(x["doc_id"]), tuple(np.round(x["embedding"], 9))) for x in out.collect())
        assert got == sorted((str(i), tuple(np.round(plain[t], 9))) for i, t in rows)
        new = [x["text"] for x in grown.collect()]
        assert sorted(new) == sorted({t for _, t in rows if t is not None})
        if limits == Limits():
            assert not [e for _, e in moved if "_t#" in e] and not [e for e in exchanges(out) if "_t#" in e]


def test_pruned_counts_give_the_same_vocabulary(spark):
    from bowline.operators.train import frequent_stats, select_vocabulary, token_stats
    r = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, weights, k=r.randint(0, 60)))) for i in range(400)],
                                 "doc_id long, text string").repartition(4).cache()
    for n, least in ((10, 3), (50, 1), (300, 4), (100_000, 2), (0, 1)):
        config = ModelConfig(max_vocabulary_size=n, min_token_frequency=least)
        full = token_stats(docs)
        want = sorted(tuple(x) for x in select_vocabulary(full, 400, config).collect())
        for sample, buckets in ((0.05, 1 << 16), (0.0, 64), (1.0, 1))[:3 if n == 50 else 1]:
            pruned = frequent_stats(docs, config, buckets, sample).cache()
            assert sorted(tuple(x) for x in select_vocabulary(pruned, 400, config).collect()) == want
            assert pruned.filter("token is null").first()["doc_freq"] == 400
            if n == 50 and buckets > 64:
                assert pruned.count() < 0.2 * full.count()


def test_projection_of_a_token_in_every_document(spark):
    from bowline.config import Limits
    from bowline.operators.embed import bm25_weights, project_sums
    r = random.Random(1)
    docs = spark.createDataFrame([(i, "everywhere " + " ".join(f"w{r.randrange(300)}" for _ in range(4))) for i in range(600)],
                                 "doc_id long, text string")
    m = train(docs, ModelConfig(embedding_dim=4, min_token_frequency=1, use_ngrams=False))
    weights = bm25_weights(docs, m)
    a, b = (sorted((x["doc_id"], x["dim"], round(x["value"], 9)) for x in project_sums(weights, m, limits).collect())
            for limits in (Limits(), Limits(broadcast_bytes=1000)))
    assert a == b and len(a) == 2400


def test_weights_meet_the_projection_without_carrying_vectors(spark, monkeypatch):
    """E3 over the limit, with many blocks of documents and runs of rows, against NumPy; no join holds weights and vectors."""
    import numpy as np
    from bowline.config import Limits
    from bowline.operators import embed as E
    monkeypatch.setattr(E, "DOCS", 40)
    r = random.Random(3)
    docs = spark.createDataFrame([(i % 190, "all " + " ".join(f"w{r.randrange(1500)}" for _ in range(12))) for i in range(200)]
                                 + [(None, "all w1 w2 w3")], "doc_id long, text string")
    m = train(docs, ModelConfig(embedding_dim=5, min_token_frequency=1))
    assert m.vocab_size > 2 * E.ROWS
    weights = E.bm25_weights(docs, m)
    rows = {x["idx"]: np.array(x["vec"]) for x in m.projection.collect()}
    want = {}
    for w in weights.collect():
        want[w["doc_id"]] = want.get(w["doc_id"], 0) + w["weight"] * rows[w["idx"]]
    for limits in (Limits(), Limits(broadcast_bytes=1000)):
        out = E.project_sums(weights, m, limits)
        got = out.collect()
        assert len(got) == 5 * len(want) and len(want) == 191
        assert all(abs(x["value"] - want[x["doc_id"]][x["dim"]]) < 1e-9 for x in got)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Join" in line and "Inner" in line and "weight" in line]
