import hashlib

import pytest

from bowline.llm import fingerprint
from bowline.llm.queries import QUERIES

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
TEXTS = {1: "one two three four five six seven", 2: "one two three four five six seven", 3: "", 4: None, 5: "short",
         9: "é🙂" * 7, 12: LONG, 20: " ".join(f"t{i}" for i in range(400)), 21: "A b\n\nC  d", 30: "tail of the list " * 40}


def edited(ids, texts):
    order = sorted(ids, reverse=True)
    out = {}
    for at, i in enumerate(order):
        t, n = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        k = len(t) // 3
        out[i] = (t[:len(t) - k] + n[:k], order[(at + 1) % len(order)])
    return out


@pytest.mark.parametrize("range_rows", [512, 1, 3])
def test_edited_texts(spark, frame, range_rows, monkeypatch):
    monkeypatch.setattr(fingerprint.with_next, "__defaults__", (range_rows,))
    docs = frame([(i, t, "en", "s") for i, t in TEXTS.items()])
    rows = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    want = edited(TEXTS, TEXTS)
    assert set(rows) == set(TEXTS)
    for i, (text, after) in want.items():
        r = rows[i]
        assert r["n_chars"] == len(TEXTS[i] or "")
        assert r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest(), i
        same = rows[after]["fingerprint"] == r["fingerprint"]
        assert (r["near_next"] == 1.0) == same
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] and rows[3]["fingerprint"] == rows[4]["fingerprint"] == ""
    assert len(rows[20]["fingerprint"]) == fingerprint.BINS * fingerprint.KEPT_BITS // 4


def test_likeness_estimates_jaccard(spark, frame):
    base = [f"w{i}" for i in range(1200)]
    rows = []
    for i, share in enumerate((0, 100, 400, 800, 1200)):
        rows.append((i, " ".join(base[:1200 - share] + [f"z{i}_{j}" for j in range(share)]), "en", "s"))
    df = fingerprint.fingerprints(frame(rows))
    bits = {r["doc_id"]: r["bits"] for r in df.collect()}

    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    for i in range(5):
        a, b = shingles(rows[0][1]), shingles(rows[i][1])
        table = spark.createDataFrame([(bits[0], bits[i])], "a array<tinyint>, b array<tinyint>")
        got = table.select(fingerprint.likeness(table.a, table.b)).first()[0]
        assert abs(got - len(a & b) / len(a | b)) < 0.15


def test_few_shingles_are_densified(spark, frame):
    rows = [(1, "a b c d e f", "en", "s"), (2, "a b c d e g", "en", "s"), (3, "p q r s t u", "en", "s")]
    b = {r["doc_id"]: r["bits"] for r in fingerprint.fingerprints(frame(rows)).collect()}
    agree = [sum(x == y for x, y in zip(b[1], b[k])) / fingerprint.BINS for k in (2, 3)]
    assert 0.15 < agree[0] < 0.6 and agree[1] < 0.1  # Jaccard 1/3 and 0


def test_ties_nulls_and_empty_tables(spark, table_dir, frame):
    op = QUERIES["op4_document_fingerprints"]
    rows = [(5, "b b b", "en", "s"), (5, "a a a", "en", "s"), (5, "a a a", "en", "s"), (None, "n n", None, None), (2, "c c c", None, None)]
    got = sorted(((r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in op(spark, table_dir(documents=frame(rows))).collect()))
    # order: (5, a), (5, a), (5, b), (2, c), null, then the first again
    want = sorted((i, n, hashlib.sha256(t.encode()).hexdigest()) for i, n, t in [
        (5, 5, "a a a"[:4] + "a"), (5, 5, "a a a"[:4] + "b"), (5, 5, "b b b"[:4] + "c"), (2, 5, "c c c"[:4] + "n"), (0, 3, "n " + "a")])
    assert got == want
    assert op(spark, table_dir(documents=frame([]))).count() == 0
    assert op(spark, table_dir(documents=frame([(None, "x y", None, None), (None, None, None, None)]))).count() == 2
    assert op(spark, table_dir(documents=frame([(7, "abcabc", None, None)]))).first()["near_next"] == 1.0
