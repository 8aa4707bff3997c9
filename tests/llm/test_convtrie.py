import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from bowline.llm import convtrie
from bowline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, words string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, group=20, shared=4):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), digest(role, text)[:16], (role, text)))
    turns = {c: [t for _, _, t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % shared
        seq = turns.get(c - c % group, [])[:h] + own[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
                  for n, m in members.items()) if turns else []


def corpus(seed=1, n=400):
    r = random.Random(seed)
    rows = []
    for c in range(-25, n):
        if c % 20 == 0 and r.random() < 0.3:
            continue  # a base that is absent
        for turn in range(r.choice([1, 1, 2, 3, 4, 6])):
            text = r.choice(["hello there", "hello  there", "yes", "no", "a b\tc", "x y z"]) if r.random() < 0.8 else f"text {r.random()}"
            rows.append((c, turn, r.choice(["user", "assistant"]) if turn == 0 else ("assistant", "user")[turn % 2], text))
    same = [("user", "Ω start"), ("assistant", "of many"), ("user", "copies")]
    rows += [(c, k, role, text) for c in range(1000, 1200) for k, (role, text) in enumerate(same)]
    rows += [(5000, k, "user", f"long {k}" if k % 7 else "again") for k in range(3000)]
    rows += [(5001, k, "user", f"long {k}" if k % 7 else "again") for k in range(2500)]
    rows += [(6000, None, "user", "first"), (6000, 0, None, "second"), (6000, 3, "user", None), (6001, 1, "", ""),
             (6002, 1, None, None), (6003, 5, "user", "tie"), (6003, 5, "assistant", "tie"), (6003, 5, "user", "tie"),
             (None, 1, "user", "nobody"), (7000, 1, "u", "ser"), (7001, 1, "us", "er"), (7020, 1, "user", "w " * 200_000)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(parts)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], r[7], r[3:]))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_query_against_brute_force(spark, table_dir, rows):
    got = QUERIES["op12_conversation_prefix_trie"](spark, table_dir(conversations=frame(spark, rows)))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    assert values(got) == sorted(brute(rows), key=lambda r: (r[0], r[1], r[7], r[3:]))


def test_small_blocks_and_pieces_change_nothing(spark, monkeypatch):
    # every conversation over many blocks and several levels of them, every end list over many pieces
    monkeypatch.setattr(convtrie, "BLOCK", 3)
    monkeypatch.setattr(convtrie, "PIECE", 4)
    r = random.Random(9)
    rows = [(c, k, "u", r.choice("ab")) for c in range(60) for k in range(r.randint(1, 40))]
    rows += [(100 + c, k, "u", "same %d" % k) for c in range(9) for k in range(30)]
    got = convtrie.conversation_trie(frame(spark, rows, 8)).drop("key", "parent")
    assert values(got) == sorted(brute(rows), key=lambda r: (r[0], r[1], r[7], r[3:]))


def test_other_groups(spark):
    rows = corpus(3, 120)
    rows = [x for x in rows if x[0] is None or x[0] < 1100]
    got = convtrie.conversation_trie(frame(spark, rows), group=7, shared=6).drop("key", "parent")
    assert values(got) == sorted(brute(rows, 7, 6), key=lambda r: (r[0], r[1], r[7], r[3:]))


def test_turnless_and_empty(spark):
    assert convtrie.conversation_trie(frame(spark, [(None, 1, "a", "b")])).collect() == []
    # a conversation whose only turn is taken from an absent base
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    (row,) = convtrie.conversation_trie(frame(spark, [(c, 0, "user", "gone")])).collect()
    assert (row["conv_id"], row["depth"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"]) == (c, 0, 1, 0, 1, 0)
    assert row["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()
