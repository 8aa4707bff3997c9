import hashlib
import random
import re

import numpy as np
import pytest

from bowline.llm import pii
from bowline.llm.queries import QUERIES

# the rules as they are stated, with plain backtracking
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def stated(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if ((kind == "email") or (kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")))
                    or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)):
                out.append((kind, m.start(), m.end()))
    return out


def join(spans):
    return ",".join("%s:%d:%d" % s for s in spans)


def noise(r, n):
    alphabet = ["a", "b@", "@", ".", "..", "com", "1", "22", "255", "256", "007", "+", "+1", " ", "-", "(", ")", "é", "😀", "_", "%", "\n",
                "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "x.y@z.org", "+49 30 1234567", "0000000000000"]
    return "".join(r.choice(alphabet) for _ in range(n))


def test_base_spans_are_those_of_the_stated_rules():
    r = random.Random(11)
    for k in range(6000):
        text = noise(r, r.randint(0, 40))
        assert pii.base_spans(text)[0] == stated(text), text


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "@" * 100_000, "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "+" * 100_000,
                                  "4444 " * 40_000, "Anna " * 40_000, "::" * 50_000, "A" * 200_000, "a (at) " * 30_000, "AB12 " * 40_000])
def test_long_texts_take_linear_time(text):
    import time
    began = time.process_time()
    pii.candidates(text)
    assert time.process_time() - began < 5


WIDE = [
    ("email", "write to jane.roe [at] example [dot] org today", "jane.roe [at] example [dot] org"),
    ("email", "mail john at example dot com please", "john at example dot com"),
    ("card", "paid 4465758382889437 4111111111111111 twice", "4111111111111111"),
    ("phone", "call +1 (202) 555-0143 4465758382889437 now", "+1 (202) 555-0143"),
    ("phone", "phone (202) 555-0143 or", "(202) 555-0143"), ("phone", "tel 030 12345678 in", "030 12345678"),
    ("ip", "host 2001:db8:0:0:0:0:2:1 up", "2001:db8:0:0:0:0:2:1"), ("iban", "IBAN DE89 3704 0044 0532 0130 00 ok", "DE89 3704 0044 0532 0130 00"),
    ("ssn", "ssn 123-45-6789 end", "123-45-6789"), ("name", "Dear Anna Schmidt, hello", "Anna Schmidt"), ("name", "Signed by Jürgen Groß yesterday", "Jürgen Groß"),
]


@pytest.mark.parametrize("kind,text,want", WIDE)
def test_wider_candidates(kind, text, want):
    assert (kind, text.index(want), text.index(want) + len(want)) in pii.candidates(text)[1]


def test_em_recovers_reliabilities():
    r = np.random.default_rng(4)
    true = r.random(200_000) < 0.3
    rate = np.stack([[[0.5, 0.4, 0.1]] * 6, [[0.5, 0.05, 0.45]] * 6])
    rate[:, 2] = [[0.1, 0.8, 0.1], [0.1, 0.05, 0.85]]   # a better labeler
    rate[:, 4] = [[0.2, 0.4, 0.4], [0.2, 0.4, 0.4]]     # a useless one
    votes = np.zeros(len(true), np.int64)
    for j in range(6):
        edges = rate[true.astype(int), j].cumsum(axis=1)
        votes = 3 * votes + (r.random(len(true))[:, None] > edges[:, :2]).sum(axis=1)
    v, n = np.unique(votes, return_counts=True)
    post, rates, share = pii.expectation_maximisation(v, n.astype(float))
    assert abs(share - 0.3) < 0.02 and np.abs(rates - rate).max() < 0.03
    assert ((post[np.searchsorted(v, votes)] >= 0.5) == true).mean() > 0.9


def test_regression_is_at_the_optimum():
    r = np.random.default_rng(2)
    f, p, n = r.integers(0, 1 << pii.FEATURES, 500), r.random(500), r.integers(1, 9, 500).astype(float)
    w = pii.regression(f, p, n)
    x = pii._design(f)
    assert np.abs(x.T @ (n * (p - 1 / (1 + np.exp(-x @ w)))) - w).max() < 1e-6


def corpus(seed=7, n=500):
    """Texts with planted data and with lookalikes: (id, text, planted)."""
    r = random.Random(seed)
    def digits(k):
        return "".join(r.choice("0123456789") for _ in range(k))
    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))
    rows = []
    for i in range(n):
        fill = [" ".join(r.choice(["ntor", "thes", "ble", "éau", "and"]) for _ in range(r.randint(2, 9))) for _ in range(3)]
        kind = r.choice(["email", "phone", "card", "ip", "spelled", "inner", "national", "none", "order", "version"])
        what = {"email": f"user{i}@mail.example.com", "phone": f"+1 ({r.randint(200, 999)}) 555-{digits(4)}", "card": card(),
                "ip": ".".join(str(r.randint(1, 250)) for _ in range(4)), "spelled": f"contact user{i} [at] example [dot] org",
                "inner": f"card {card()} {card()}", "national": f"phone (2{digits(2)}) 555-{digits(4)}",
                "none": "", "order": f"order no. {digits(16)}", "version": f"version 3.{digits(2)}.1 build 99{digits(5)}"}[kind]
        rows.append((i, f"{fill[0]} {what} {fill[1]}", kind))
    return rows


def test_query_against_the_stated_rules(spark, frame, table_dir):
    rows = corpus()
    texts = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "😀 a@b.co"), (None, "x 1.2.3.4"), (0, rows[0][1]), (0, rows[0][1]),
                                            (903, "word " * 100_000 + "a@b.co")]
    got = QUERIES["op11_pii"](spark, table_dir(documents=frame([(i, t, "en", "s") for i, t in texts]))).collect()
    key = {i: t for i, t in texts}
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in texts)
    added = {}
    for r in got:
        base = stated(key[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(k == s[0] for s in base) for k in pii.BASE]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(join(base).split(",")) - {""} <= set(spans)
        added[r["doc_id"]] = set(spans) - set(join(base).split(","))
    found = {i: bool(added[i]) for i, _, k in rows if k in ("spelled", "inner", "national")}
    assert sum(found.values()) >= 0.95 * len(found)
    assert not any(added[i] for i, _, k in rows if k in ("none", "order", "version", "email", "ip"))


def test_general_interface_and_redaction(spark):
    rows = [(i, t) for i, t, _ in corpus()]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id long, body string, spans string, doc_id string")
    model = pii.train(docs, "body")
    found = pii.find(docs, model, "id", "body")
    text = "mail a@b.co and +1 (202) 555-0143 end"
    one = spark.createDataFrame([(1, text)], "id long, body string")
    got = one.crossJoin(pii.find(one, model, "id", "body").select("spans")).select(pii.redacted(pii.F.col("body"), pii.F.col("spans"))).first()[0]
    assert got == "mail [email] and [phone] end"
    spans = [s for r in found.collect() for s in r["spans"]]
    assert all(0 <= s["p"] <= 1 for s in spans) and any(not s["base"] for s in spans)


def test_partitions_do_not_matter(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(3, 200)], "doc_id long, text string")
    a, b = (pii.train(docs.repartition(k)) for k in (1, 7))
    assert set(a) == set(b) and all(np.array_equal(a[k], b[k]) for k in a)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(docs, pii.train(docs)).collect() == []
