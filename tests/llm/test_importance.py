import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from bowline.llm import importance
from bowline.llm.bytetext import slices
from bowline.llm.queries import QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


def grams(text, lo, hi):
    w = split(text)
    return [b" ".join(w[i:i + n]) for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


def brute(docs, bench, buckets=10_000, lo=1, hi=1, percent=10, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(zlib.crc32(g) % buckets for g in grams(text, lo, hi))
    for text in bench:
        t.update(zlib.crc32(g) % buckets for g in grams(text, lo, hi))
    sn, tn = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        gs = [zlib.crc32(g) % buckets for g in grams(text, lo, hi)]
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (sn + buckets) / ((s[b] + 1) * (tn + buckets)))) for b in gs)
        weight = total // len(gs) if gs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None, len(split(text))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for place, r in enumerate(may[:percent * len(may) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(seed=5, n=300):
    r = random.Random(seed)
    vocabulary = ["Alpha", "beta", "Γάμμα", "数据", "x" * 40, "y" * 33, "z" * 32, "w" * 31, "9", "code", "Zürich"] + [
        f"w{k}" for k in range(80)]
    rows = [(i, r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(60)]  # copies
    rows += [(n + 100, None), (n + 101, ""), (n + 102, "...!"), (n + 103, "Alpha beta " * 30_000), (None, "alpha " * 25),
             (None, None), (0, rows[0][1]), (0, rows[0][1]), (7, rows[9][1]), (n + 104, "Ａ" * 50_000)]
    return rows


BENCH = ["alpha beta w1 w2 w3 数据", "w5 w6 Γάμμα " + "y" * 33, None, "", "x" * 40]


def test_query_against_brute_force(spark, frame, table_dir):
    rows = corpus()
    bench = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(BENCH)], "item_id long, text string, score string")
    where = table_dir(documents=frame([(i, t, "en", "s") for i, t in rows]), benchmark=bench)
    got = QUERIES["op13_importance_resampling"](spark, where)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, BENCH)


def test_longer_runs_and_few_buckets(spark):
    rows = corpus(8, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in BENCH], "text string")
    got = importance.resample(docs, bench, buckets=97, min_n=1, max_n=3, percent=37, least_words=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, BENCH, 97, 1, 3, 37, 3)


def test_hash_equals_the_library():
    r = random.Random(3)
    buf = np.array([r.randrange(256) for _ in range(4000)], np.uint8)
    start = np.array([r.randrange(3800) for _ in range(500)] + [4000 - k for k in range(1, 40)])
    length = np.array([r.randrange(1, 70) for _ in range(500)] + list(range(1, 40)))
    want = [xxhash.xxh64_intdigest(buf[s:s + n].tobytes()) for s, n in zip(start, length)]
    assert importance.xxh64(buf, start, length).tolist() == want


@pytest.mark.parametrize("keys", [None, "equal", "few"])
def test_interning_verifies_bytes(keys):
    import pyarrow as pa
    texts = [t for _, t in corpus(4, 40)][:40] + ["abcdefgh abcdefgi abcdefg", "x" * 64 + " " + "x" * 63 + "y"]
    (_, _, raw, offs), = slices(pa.array(texts))
    buf, w = importance.compact(raw, offs)
    _, start, length = importance.features(w, 1, 2)
    # with equal keys only the bytes can tell features apart
    given = {None: None, "equal": np.zeros(len(start), np.uint64), "few": (length % 3).astype(np.uint64)}[keys]
    table = importance.Interned(buf, start, length, 1000, given)
    text = [buf[s:s + n].tobytes() for s, n in zip(start, length)]
    by_slot = {}
    for slot, feature in zip(table.slot, text):
        assert by_slot.setdefault(slot, feature) == feature
        assert table.bucket[slot] == zlib.crc32(feature) % 1000
    assert len(set(by_slot.values())) == len(by_slot)
    assert {by_slot[s]: int(table.count[s]) for s in by_slot} == Counter(text)


def test_equal_rows_are_expanded_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(importance, "EXPAND", 7)
    rows = spark.range(100).selectExpr("cast(id % 3 as long) as a")
    got = importance.ranked(rows, [importance.F.desc("a")]).collect()
    assert sorted((r["rank"], -r["a"]) for r in got) == [(k + 1, -a) for k, a in enumerate([2] * 33 + [1] * 33 + [0] * 34)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "text string")
    assert importance.resample(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    (row,) = importance.resample(one, bench, least_words=1, percent=100).collect()
    assert (row["n_features"], row["rank"]) == (3, 1)
