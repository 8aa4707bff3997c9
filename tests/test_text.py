from collections import Counter

from pyspark.sql import functions as F

from bowline.functions import text as T


def _tok(spark, texts, fn=T.tokenize):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r[0] for r in df.orderBy("id").select(fn(F.col("text"))).collect()]


def test_reference_tokenization(spark):
    assert _tok(spark, ["Hello, world! This is a TEST."]) == [["hello", "world", "test"]]


def test_edge_cases(spark):
    got = _tok(spark, ["", "the a of it", "word", "x é 日 ab", "café café", "\tpad  "])
    assert got[0] == [] and got[1] == [] and got[2] == ["word"]
    assert got[3] == ["é", "日", "ab"]          # byte length: é and 日 kept, x dropped
    assert got[4] == ["café", "café"]          # NFC composes e + U+0301
    assert got[5] == ["pad"]


def test_process_text_bigrams_bridge_stop_words(spark):
    got = _tok(spark, ["alpha the beta", "solo"], lambda c: T.process_text(c, True))
    assert got[0] == ["alpha", "beta", "alpha_beta"]
    assert got[1] == ["solo"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a1", "b2", "c3"],), ([],)], "t array<string>")
    rows = df.select(T.ngrams(F.col("t"), 2).alias("g2"), T.ngrams(F.col("t"), 3).alias("g3"),
                     T.ngrams(F.col("t"), 4).alias("g4")).collect()
    assert rows[0]["g2"] == ["a1_b2", "b2_c3"] and rows[0]["g3"] == ["a1_b2_c3"] and rows[0]["g4"] == []
    assert rows[1]["g2"] == []


def test_term_bag_matches_counter(spark):
    import random
    rnd = random.Random(7)
    arrays = [[rnd.choice("abcdef") * 2 for _ in range(rnd.randint(0, 30))] for _ in range(40)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "id long, t array<string>")
    got = df.orderBy("id").select(T.term_bag(F.col("t")).alias("b")).collect()
    for arr, row in zip(arrays, got):
        assert {e["token"]: e["tf"] for e in row["b"]} == dict(Counter(arr))


def test_nfc_guard_covers_all_changes_below_u0300():
    import unicodedata
    for cp in range(0x300):
        assert unicodedata.is_normalized("NFC", chr(cp))
    # no canonical composition starts from a pair of characters below U+0300
    for cp in range(0x110000):
        d = unicodedata.decomposition(chr(cp))
        if d and not d.startswith("<"):
            parts = [int(x, 16) for x in d.split()]
            if len(parts) == 2:
                assert parts[1] >= 0x300


def test_nfc_matches_unicodedata(spark):
    import random
    import unicodedata
    rnd = random.Random(2)
    pool = [c for c in range(0x20, 0x3400) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    marks = [c for c in pool if unicodedata.combining(chr(c))]
    texts = []
    for i in range(3000):
        s = "".join(chr(rnd.choice(marks if rnd.random() < 0.4 else pool)) for _ in range(rnd.randint(1, 10)))
        texts.append((i, unicodedata.normalize("NFD", s) if i % 2 else s))
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: r["n"] for r in df.select("id", T.nfc(F.col("text")).alias("n")).collect()}
    assert all(got[i] == unicodedata.normalize("NFC", t) for i, t in texts)


def test_nfc_holds_a_few_rows_as_strings_and_returns_only_changed_ones():
    import tracemalloc
    import unicodedata
    import pyarrow as pa
    long = "l\u2019\u00e9t\u00e9 " * 2000
    texts = [None, "", "cafe\u0301", long + "e\u0301", *[long] * 3000, None, "e\u0301"]
    column = pa.array(texts, pa.string())
    tracemalloc.start()
    got = T._composed.func(column)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [g for g in got.to_pylist() if g is not None] == [unicodedata.normalize("NFC", texts[i]) for i in (2, 3, -1)]
    assert len(got) == len(texts) and got[2].is_valid and got[3].is_valid and got[len(texts) - 1].is_valid
    assert held < 8 << 20  # the 3,000 texts are 72 MB as Python strings
    assert len(T._composed.func(column.slice(0, 0))) == 0 and T._composed.func(column.slice(0, 2)).to_pylist() == [None, None]


def test_tokens_on_the_buffer_equal_a_regex():
    import random
    import pyarrow as pa
    import regex
    from bowline.functions import grams, tokens
    rnd = random.Random(8)
    pool = ["the", "of", "a", "alpha", "beta", "x", " ", "  ", "-", "_", ".", "é", "日本", "ß", "\u0301", "\u0345", "Ⅷ", "½", "٣",
            "\U0001d7d9", "\U0001f642", "\U00020000", "ª", "º", "\u200d", "\ud7ff", "\ue000", "\ufffd"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25))) for _ in range(600)] + [None, "", "a", "日", "the of"]
    column = pa.array(texts)

    def plain(t):
        words = [w for w in regex.split(r"[^\p{Alphabetic}\p{N}]+", t) if len(w.encode()) >= 2 and w not in tokens.STOP_WORDS]
        return words, [f"{a}_{b}" for a, b in zip(words, words[1:])]

    for limit in (1, 40, 1 << 20):
        keep, grams_limit = grams.runs, limit
        tokens.runs = lambda c: keep(c, grams_limit)
        try:
            one, two = tokens.token_lists(column, False).to_pylist(), tokens.token_lists(column, True).to_pylist()
            seen = {}
            for t in tokens.token_runs(column):
                for term, n, d in zip(*(x.tolist() if hasattr(x, "tolist") else x.to_pylist() for x in tokens.counts(t, True))):
                    got = seen.setdefault(term, [0, 0])
                    got[0] += n
                    got[1] += d
        finally:
            tokens.runs = keep
        assert one == [None if t is None else plain(t)[0] for t in texts]
        assert two == [None if t is None else sum(plain(t), []) for t in texts]
        total, docs = Counter(), Counter()
        for t in filter(None, texts):
            total.update(sum(plain(t), []))
            docs.update(set(sum(plain(t), [])))
        assert {k: tuple(v) for k, v in seen.items()} == {k: (total[k], docs[k]) for k in total}


def test_vocabulary_blocks_find_terms():
    import random
    import pyarrow as pa
    from bowline.functions import tokens
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "éa"]
    terms = ["beta", "alpha_beta", "gamma_gamma", "éa_alpha", "omega", "delta", "beta_omega"]
    texts = [" ".join(rnd.choice(words + ["the"]) for _ in range(rnd.randint(0, 12))) for _ in range(80)]
    vocab = tokens.Vocabulary(terms)
    for use_ngrams in (True, False):
        lists = tokens.token_lists(pa.array(texts), use_ngrams).to_pylist()
        (t,) = tokens.token_runs(pa.array(texts))
        row, index = vocab.find(t, use_ngrams)
        assert sorted(zip(row.tolist(), index.tolist())) == sorted(
            (i, terms.index(x)) for i, xs in enumerate(lists) for x in xs if x in terms)
    assert [len(x) for x in tokens.Vocabulary([]).find(t, True)] == [0, 0]
