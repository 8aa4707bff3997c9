import math
import random
import zlib
from collections import defaultdict

import numpy as np

from bowline.llm import toxicity
from bowline.llm.queries import QUERIES

CALM = "the river runs past a quiet house and over many small stones before noon".split()
RUDE = ["zblarg", "kwoxtu"]


def corpus(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(CALM) for _ in range(r.randint(20, 60))]
        bad = i % 3 == 0
        if bad:
            for w in r.sample(range(len(words)), 3):
                words[w] = r.choice(RUDE)
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark, table_dir, frame):
    rows, labels = corpus(240, 5)
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "the river runs over zblarg stones and kwoxtu", None, None), (1002, "ab", None, None),
             (1003, "the river " * 20_000 + "zblarg kwoxtu", None, None), (0, rows[0][1], "en", "s")]
    labels += [(0, 1, 1), (2, 1, None), (None, 0, 1), (5000, 0, 1)]
    d = table_dir(documents=frame(rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = QUERIES["op5_toxicity"](spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        if i is None or i < 240 or i == 1003:
            assert r["predicted"] == int(i is None or i % 3 == 0 and i < 240 or i == 1003)
        else:
            assert r["predicted"] == 0


def test_without_labels_or_documents(spark, table_dir, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = QUERIES["op5_toxicity"](spark, table_dir(documents=frame([(1, "a b c d e", None, None)]), labels=none)).collect()
    assert [(r["doc_id"], r["predicted"]) for r in got] == [(1, 0)]
    assert QUERIES["op5_toxicity"](spark, table_dir(documents=frame([]), labels=none)).count() == 0


def test_texts_of_a_few_bytes_are_judged(spark, table_dir, frame):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        words = [r.choice(CALM) for _ in range(r.randint(1, 30))]
        if i % 3 == 0:
            words[r.randrange(len(words))] = r.choice(["zqk", "vuxo"])
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(i % 3 == 0)))
    short = {1000: ("zqk", 1), 1001: ("vuxo", 1), 1002: ("VUXO", 1), 1004: ("over", 0), 1005: ("a", 0),
             1006: ("the", 0), 1007: ("", 0), 1008: (None, 0), 1009: (" ", 0)}
    d = table_dir(documents=frame(rows + [(i, t, "en", "s") for i, (t, _) in short.items()]),
                  labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x["predicted"] for x in QUERIES["op5_toxicity"](spark, d).collect()}
    assert {i: got[i] for i in short} == {i: toxic for i, (_, toxic) in short.items()}


def brute_ratios(texts, text):
    """Kneser-Ney by dictionaries: {gram: log ratio} of the grams of ``text``."""
    n, order, d = [defaultdict(int), defaultdict(int)], toxicity.ORDER, toxicity.DISCOUNT
    sym = [bytes(toxicity.SYMBOL[np.frombuffer(f" {t} ".encode() if t else b"", np.uint8)]) for t, _ in texts]
    for s, (_, c) in zip(sym, texts):
        for g in {s[i:i + order] for i in range(len(s) - order + 1)}:
            n[c][g] += 1
    level = set(n[0]) | set(n[1])
    p = {}
    shorter = [level]
    for k in range(order - 1, 0, -1):
        shorter.append({g[1:] for g in shorter[-1]})
    for k in range(1, order):
        longer = shorter[order - 1 - k]
        kinds = defaultdict(int)
        for g in longer:
            kinds[g[1:]] += 1
        total, t = defaultdict(int), defaultdict(int)
        for g, v in kinds.items():
            total[g[:-1]] += v
            t[g[:-1]] += 1
        q = p
        p = {g: v / total[b""] if k == 1 else (max(v - d, 0) + d * t[g[:-1]] * q[g[1:]]) / total[g[:-1]]
             for g, v in kinds.items()}
    def back(c, h):
        of = [v for g, v in n[c].items() if g[:-1] == h]
        return (d * len(of) / sum(of), sum(of)) if of else (1.0, 0)
    s = bytes(toxicity.SYMBOL[np.frombuffer(text.encode(), np.uint8)])
    out = []
    for i in range(len(s) - order + 1):
        g = s[i:i + order]
        (w0, a0), (w1, a1) = back(0, g[:-1]), back(1, g[:-1])
        if g in level:
            out.append(math.log(((max(n[1][g] - d, 0) / a1 if a1 else 0) + w1 * p[g[1:]])
                                / ((max(n[0][g] - d, 0) / a0 if a0 else 0) + w0 * p[g[1:]])))
        else:
            out.append(math.log(w1 / w0))
    return out


def test_model_against_dictionaries(spark):
    texts = [("You are a zblarg!", 1), ("You were an artist 42", 0), ("an artist zblarg", 1), ("é artist", 0), ("abc", 0), ("", 1)]
    model = toxicity.train(spark.createDataFrame(texts, "text string, toxic int"))
    tables = [(toxicity.Table(b.value.column("key").to_numpy(), b.value.column("ratio").to_numpy()), shift)
              for b, shift in toxicity.blocks_of(model)]
    for text in ("you are an artist, zblarg 77", "quite new words é artist"):
        raw = np.frombuffer(text.encode(), np.uint8)
        np.testing.assert_allclose(np.nan_to_num(toxicity.ratios(raw, tables)), brute_ratios(texts, text), atol=1e-4)
    docs = spark.createDataFrame([(1, "you are an artist, zblarg 77"), (2, None), (3, "abc"), (4, "quite new artist")],
                                 "doc_id long, text string")
    whole, cut = (sorted(map(tuple, toxicity.window_ratios(docs, toxicity.blocks_of(model, n)).collect()))
                  for n in (1 << 20, 9))
    assert whole == cut


def test_labels_join_either_way(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (4, 1), (None, 1)], "doc_id long, toxic int")
    for limit in (0, 1 << 20):
        got = sorted(map(tuple, toxicity.with_labels(docs, labels, limit).collect()))
        assert got == [(1, "a", 1), (1, "b", 1), (2, "c", 0)]


def test_windows_and_curve():
    r, row = np.array([1.0, 3, -1, 5, 5, 0, 2]), np.array([0, 0, 0, 2, 2, 2, 3])
    np.testing.assert_allclose(toxicity.worst_window(r, row, 5, 2), [2, 0, 5, 2, 0])
    x, y = toxicity.isotonic(np.array([0.0, 0, 1, 1, 2, 3]), np.array([0.0, 1, 0, 1, 0, 1]), np.array([9.0, 1, 5, 5, 3, 8]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all() and 0 < y[0] < 0.2 and y[-1] > 0.8
    t = toxicity.Table(np.arange(0, 5000, 7, dtype=np.int64), np.arange(0, 5000, 7).astype(np.float32))
    got, miss = t.get(np.arange(5000))
    assert len(miss) == 5000 - len(range(0, 5000, 7)) and (got[::7] == np.arange(0, 5000, 7)).all()
