import random

import pytest
import xxhash

from bowline.llm import simhash
from bowline.llm.queries import QUERIES


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    """{id: smallest id reachable} by looking at every pair."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[ids[a]] ^ fps[ids[b]]).count("1") <= bits:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark, table_dir, frame):
    r = random.Random(11)
    rows = [(i, " ".join("w%d" % r.randint(0, 500) for _ in range(r.randint(1, 120))), "en", "s") for i in range(60)]
    for i in range(60, 110):  # near copies and chains of them
        words = rows[r.randint(0, i - 1)][1].split(" ")
        words[r.randint(0, len(words) - 1)] = "edit%d" % i
        rows.append((i, " ".join(words), "en", "s"))
    rows += [(200, None, None, None), (201, "", "en", "s"), (202, " \t\n", "en", "s"), (203, "ONE", "en", "s"),
             (204, "one two É", "en", "s"), (205, "x " * 50_000, "en", "s"), (206, rows[0][1].upper(), "en", "s"),
             (207, "one", "en", "s"), (3, rows[3][1], "en", "s")]
    got = QUERIES["op6_simhash_near_dedup"](spark, table_dir(documents=frame(rows))).collect()
    assert len(got) == len(rows)
    fps = {i: brute_fp(t) for i, t, _, _ in rows}
    want = brute_components(fps)
    for g in got:
        assert int(g["fingerprint"], 16) == fps[g["doc_id"]] and len(g["fingerprint"]) == 16
        assert g["component_id"] == want[g["doc_id"]]


@pytest.mark.parametrize("max_bits", [0, 3, 4])
def test_every_link_is_found_among_dense_fingerprints(spark, max_bits):
    r = random.Random(max_bits)
    fps = set()
    for c in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            fp = centre
            for b in r.sample(range(64), r.randint(0, max_bits + 3)):
                fp ^= 1 << b
            fps.add(fp)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {x["node"]: x["root"] for x in simhash.link_components(nodes, max_bits).collect()}
    want = brute_components({f: f & ((1 << 64) - 1) for f in sorted(signed)}, max_bits)
    assert {f: got.get(f, f) for f in signed} == want


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 1001: 1000}


def test_null_ids_and_empty_table(spark, table_dir, frame):
    op = QUERIES["op6_simhash_near_dedup"]
    rows = [(None, "a b c", None, None), (None, "a b c", None, None), (4, "p q r s t", None, None), (None, "p q r s t", None, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in op(spark, table_dir(documents=frame(rows))).collect()),
                 key=lambda x: tuple((v is None, v) for v in x))
    assert got == [(4, 4), (None, 4), (None, None), (None, None)]
    assert op(spark, table_dir(documents=frame([]))).count() == 0
