import hashlib
import random
import re

import pytest

from bowline.llm import decontam
from bowline.llm.queries import QUERIES
from bowline.llm.tables import ROW

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        n = min(13, len(iw))
        wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for p in range(len(w) - n + 1 if n else 0):
            if tuple(w[p:p + n]) in wins:
                hit |= set(range(p, p + n))
                if item is not None:
                    found.add(str(item))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
            len(hit) > 0 and 20 * len(hit) >= len(w))


def corpus(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 5, 9, 12, 13, 14, 30])))) for i in range(25)]
    items += [(25, items[0][1]), (26, None), (27, "..."), (None, "nul id words here in a window of thirteen words or more than that"),
              (3, items[3][1]), (100, "É日本 42"), (7, "w1 " * 20)]
    docs = []
    for i in range(80):
        t = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if r.random() < 0.5:
            t[r.randint(0, len(t)):0] = (r.choice(items)[1] or "").upper().replace(" ", ", ").split(" ")
        docs.append((i, " ".join(t), "en", "s"))
    docs += [(80, None, None, None), (81, "", "en", "s"), (82, "!!", "en", "s"), (None, items[9][1], None, None),
             (84, "é日本 42", "en", "s"), (85, "x É日本 42 y", "en", "s"), (86, "w1 " * 50_000, "en", "s"), (0, docs[0][1], "en", "s"),
             (87, items[-4][1] if items[-4][1] else "", "en", "s")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, table_dir, frame, seed):
    docs, items = corpus(seed)
    d = table_dir(documents=frame(docs), benchmark=spark.createDataFrame(
        [(i, t, "clash") for i, t in items], "item_id long, text string, n string"))
    got = sorted((tuple(r) for r in QUERIES["op8_benchmark_decontamination"](spark, d).collect()), key=str)
    want = sorted(((i, *brute(t, items)) for i, t, _, _ in docs), key=str)
    assert got == want


def test_blocks_give_the_same_rows(spark, frame):
    docs, items = corpus(3)
    df, bench = frame(docs), spark.createDataFrame(items, "item_id long, text string")
    index = decontam.build_index(df, bench, block_rows=20)
    def rows(out):
        return sorted(out.selectExpr(f"{ROW}.doc_id", "spans", "items", "n_words", "n_hit", "contaminated").collect(), key=str)
    assert rows(decontam.match(df, index, block_rows=15)) == rows(decontam.match(df, index))


def test_empty_tables(spark, table_dir, frame):
    op = QUERIES["op8_benchmark_decontamination"]
    none = spark.createDataFrame([], "item_id long, text string")
    got = op(spark, table_dir(documents=frame([(1, "a b", None, None)]), benchmark=none)).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got] == [(2, 0, False)]
    assert op(spark, table_dir(documents=frame([]), benchmark=none)).count() == 0
