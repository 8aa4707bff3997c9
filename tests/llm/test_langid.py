import random
import zlib

import numpy as np

from bowline.llm import langid
from bowline.llm.bytetext import slices
from bowline.llm.queries import QUERIES
import pyarrow as pa

WORDS = {"en": "the and of that with this from they have which".split(), "de": "der und nicht schön über mit dass für ich auch".split(),
         "ja": "これは 本です 東京 へ 行きます 私の 名前 今日は 天気 が".split()}


def corpus(n, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(4, 40))), lang, "s")
            for i in range(n) for lang in [r.choice(list(WORDS))]]


def test_held_out_rows_and_edge_cases(spark, table_dir, frame):
    rows = corpus(300)
    odd = [(900, None, "en", "s"), (901, "", None, "s"), (902, "12 34 !!", "en", "s"), (None, rows[0][1], None, None),
           (903, "und " + "der über " * 30_000, None, "s"), (904, "東", None, None), (5, rows[5][1], rows[5][2], "s"),
           (906, "İİ the and", "en", "s"), (907, "½ ②", "en", "s"), (908, "Ⅷ ²", None, "s"), (909, "٣ ৪ ₂", "de", "s")]
    got = QUERIES["op7_language_id"](spark, table_dir(documents=frame(rows + odd))).collect()
    assert len(got) == len(rows) + len(odd)
    of = {i: (t, lang) for i, t, lang, _ in rows}
    wrong = 0
    for g in got:
        i = g["doc_id"]
        assert g["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1 and g["lang_pred"] in {*WORDS, "und"}
        if i in (900, 901, 902, 907, 908, 909):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
        elif i in of and g["held_out"]:
            wrong += g["lang_pred"] != of[i][1]
    assert wrong == 0
    assert {g["lang_pred"] for g in got if g["doc_id"] == 903} == {"de"}


def test_samples_are_bounded(spark, frame):
    rows = frame(corpus(3000, 2), extra=False).selectExpr("lang", "text", "rand(1) as a", "rand(2) as b")
    first = langid.sampled(rows, 200, "a")
    second = langid.sampled(first, 20, "b")
    for df, n in ((first, 200), (second, 20)):
        for r in df.groupBy("lang").count().collect():
            assert 0.4 * n < r["count"] < 1.8 * n


def test_presence_against_sets():
    texts = ["Ab ab", "", "x", "日本語 日本", "ab"]
    column = pa.array([*texts, None])
    for lo, hi, raw, offs in slices(column):
        x, letters = langid.presence(raw, offs)
    assert letters.tolist() == [True, False, True, True, True, False]
    for t, row in zip(texts, x):
        grams = {t.lower()[i:i + k] for k in range(1, langid.MAX_N + 1) for i in range(len(t) - k + 1)}
        assert row.sum() == len(grams)
    shared = {t[i:i + k] for t in ["ab"] for k in (1, 2) for i in range(len(t) - k + 1)}
    assert (x[0] & x[4]).sum() == len(shared)


def test_scores_equal_the_kernel_form(spark, frame):
    """x (L' a) / |x| is K(x, L) a with the coefficients solved from the kernel matrices."""
    rows = corpus(60, 4)
    docs = frame(rows, extra=False)
    languages, weights = langid.train(docs)
    x = np.concatenate([m for _, _, m, _ in langid.matrices(pa.array([t for _, t, _, _ in rows]))])
    f = langid.unit(x) @ weights
    assert [languages[i] for i in f.argmax(1)] == [lang for _, _, lang, _ in rows]


def test_no_training_rows_and_empty_table(spark, table_dir, frame):
    op = QUERIES["op7_language_id"]
    got = op(spark, table_dir(documents=frame([(1, "some text", None, None)]))).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert op(spark, table_dir(documents=frame([]))).count() == 0


def invented(lang, n, seed):
    """Characters of a language with 2,000 letters of its own, some frequent."""
    r = random.Random(seed)
    first = {"ja": 0x4E00, "ko": 0xAC00}[lang]
    return "".join(chr(first + min(int(r.paretovariate(0.6)) - 1, r.randrange(2000))) for _ in range(n))


def test_windows_cover_the_text():
    text = "".join(chr(0x4E00 + i % 5000) for i in range(12_345))
    cut = langid.windows(text)
    assert all(langid.WINDOW // 2 <= len(w) <= langid.WINDOW + langid.MAX_N for w in cut)
    for k in range(1, langid.MAX_N + 1):
        assert {w[i:i + k] for w in cut for i in range(len(w) - k + 1)} >= {text[i:i + k] for i in range(len(text) - k + 1)}
    assert langid.windows("") == [""] and langid.windows("short") == ["short"]


def test_long_texts_of_many_distinct_ngrams_score_like_short_ones(spark, frame):
    rows = [(i, invented(lang, 800, i), lang, "s") for i in range(120) for lang in [("ja", "ko")[i % 2]]]
    rows += [(1000 + i, t, lang, "s") for i, t, lang, _ in corpus(120, 9) if lang != "ja"]
    model = langid.train(frame(rows, extra=False))
    sizes = (800, 20_000, 50_000, 400_000)
    asked = [(10_000 * k + n, invented(lang, n, -n), lang, None) for k, lang in enumerate(("ja", "ko")) for n in sizes]
    got = langid.identify(frame(asked, extra=False), model).select("_row.lang", "_row.n_chars", "lang_pred", "score").collect()
    assert len(got) == 8 and all(r["lang_pred"] == r["lang"] for r in got)
    for lang in ("ja", "ko"):
        score = {r["n_chars"]: r["score"] for r in got if r["lang"] == lang}
        assert all(abs(score[n] - score[800]) < 0.1 for n in sizes), score


def test_prediction_equals_the_kernel_form_from_sets(spark, monkeypatch):
    """K(x, L) a with kernels counted on sets of n-grams and a solved from the same sums, against the scored rows."""
    monkeypatch.setattr(langid, "WINDOW", 40)
    rows = [(i, t, lang) for i, t, lang, _ in corpus(120, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {}
    keep = langid.landmark_matrix
    monkeypatch.setattr(langid, "landmark_matrix", lambda bits: held.setdefault("bits", bits) and keep(bits))
    languages, weights = langid.train(docs)
    landmarks = [set(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8)))) for b in held["bits"]]

    def slots(window):
        x, _ = langid.grams([window])
        return set(np.flatnonzero(x[0]))

    def kernel(text):
        cut = [slots(w) for w in langid.windows(text.lower()) if langid.has_letter(w)]
        return np.mean([[len(x & y) / np.sqrt(len(x) * len(y)) for y in landmarks] for x in cut], axis=0)

    k = np.array([kernel(t) for _, t, _ in rows])
    target = np.array([[1.0 if lang == v else -1.0 for v in languages] for _, _, lang in rows])
    k_ll = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in landmarks] for x in landmarks])
    a = np.linalg.solve(k.T @ k + langid.RIDGE * k_ll + 1e-6 * np.eye(len(landmarks)), k.T @ target)
    f = k @ a
    got = {r["_row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, (languages, weights)).collect()}
    for (i, _, _), own in zip(rows, f):
        assert got[i][0] == languages[own.argmax()] and abs(got[i][1] - np.clip((own.max() + 1) / 2, 0, 1)) < 1e-3


def test_cuts_of_few_rows_are_pooled(spark):
    """Any number of left-out rows gives cuts; one class with few rows is judged with the shorter ones."""
    rows = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    model = langid.train(docs, use=~langid.left_out())
    for least in (1, 10, 10_000):
        langid_least, langid.LEAST_ROWS = langid.LEAST_ROWS, least
        try:
            found = langid.cuts(docs, model, langid.left_out())
        finally:
            langid.LEAST_ROWS = langid_least
        assert found and [n for n, _ in found] == sorted({n for n, _ in found})
        assert all(0.25 < cut < 1 for _, cut in found)
    assert langid.cuts(docs.limit(0), model, langid.left_out()) == []


def test_the_fit_and_the_cuts_are_over_all_rows(spark, monkeypatch):
    """However few rows the landmarks come from."""
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows], "doc_id long, text string, lang string")
    model = langid.train(docs, use=~langid.left_out())
    want = langid.cuts(docs, model, langid.left_out())
    monkeypatch.setattr(langid, "PER_LANGUAGE", 20)
    assert langid.cuts(docs, model, langid.left_out()) == want
    test_prediction_equals_the_kernel_form_from_sets(spark, monkeypatch)
