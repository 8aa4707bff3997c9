import random
from collections import defaultdict

from bowline.llm import packing
from bowline.llm.queries import QUERIES


def plain_best_fit(items, capacity):
    """Every open bin is looked at for every item."""
    bins, out = [], []
    for n, s, c in items:
        fits = [(b["free"], i) for i, b in enumerate(bins) if b["free"] >= n
                and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"free": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        bins[i]["free"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


def test_best_fit_against_brute_force():
    r = random.Random(3)
    for _ in range(60):
        items = sorted(((r.randint(1, 30), r.choice([None, 1, 1, 1, 2, 3, 4, 5]), r.choice([None] + list(range(9))))
                        for _ in range(r.randint(0, 80))), key=lambda x: -x[0])
        lengths, sources, clusters = (list(x) for x in zip(*items)) if items else ([], [], [])
        assert packing.best_fit(lengths, sources, clusters, 30) == plain_best_fit(items, 30)


def docs_of(seed, n):
    r = random.Random(seed)
    rows = [(i, " ".join(["w%d" % r.randint(0, 9)] * r.randint(0, 60)), "en", r.choice(["hot", "hot", "a", "b", None]))
            for i in range(n)]
    return rows + [(n, None, "en", "a"), (n + 1, " \n ", "en", "a"), (n + 2, "long " * 1000, "en", "b"), (0, rows[0][1], "en", "hot")]


def test_pieces_cover_documents_and_bins_keep_the_rules(spark, frame):
    rows = docs_of(1, 300)
    got = packing.pack(frame(rows), capacity=50, shard_rows=64).collect()
    want = defaultdict(int)
    for i, t, _, _ in rows:
        want[i] += len((t or "").split())
    have = defaultdict(int)
    bins = defaultdict(list)
    by_id = {i: (t, s) for i, t, _, s in rows}
    for r in got:
        have[r["doc_id"]] += r["n_words"]
        assert (r["bin_id"] is None) == (r["n_words"] == 0) and r["n_words"] <= 50
        assert r["first_word"] == r["piece"] * 50
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    assert dict(have) == dict(want)
    for held in bins.values():
        assert sum(r["n_words"] for r in held) <= 50
        sources = [by_id[r["doc_id"]][1] for r in held if by_id[r["doc_id"]][1] is not None]
        texts = [tuple(by_id[r["doc_id"]][0].lower().split()) for r in held]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_query_over_edge_cases(spark, table_dir, frame):
    rows = [(None, "a b", None, None), (None, "a b", None, None), (1, "x", "en", "s"), (1, "x", "en", "s")]
    got = QUERIES["op3_best_fit_packing"](spark, table_dir(documents=frame(rows))).collect()
    assert len(got) == 4 and len({r["bin_id"] for r in got if r["doc_id"] == 1}) == 2
    assert QUERIES["op3_best_fit_packing"](spark, table_dir(documents=frame([]))).count() == 0
