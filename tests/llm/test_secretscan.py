import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

from bowline.llm import secretscan
from bowline.llm.queries import QUERIES

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                              re.I | re.A), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
RANDOM = "q7x2vkm9zl4wtb8njc6yhd3f"
TEXTS = ["password=abc token: 'secret99' x", "passwd = \"a.b-c_d=\" AKIA" + "Z9" * 8, "AKIA" + "1" * 15, "🙂é api_key=" + "ab" * 15,
         "APIKEY:xyz123", "password=token:abcdefgh", "0" * 23 + " " + "0123456789abcdef" * 2, None, "", "token=" * 40,
         f"see {RANDOM} here", "the interoperability_requirements_document", "4111111111111111 4222222222222222",
         ("filler words " * 3000 + "secret=hunter22 ") * 3, "a\u0001b password:zzzzzz\u0001", "tokén=abcdef ſecret=abcdefg"]


STEMS = "inter national docu mentation charac teris requi rement configu ration reposi tory".split()
PROSE = [" ".join("".join(p) for p in itertools.permutations(STEMS, 3))]


def brute(text):
    text = text or ""
    return [sorted((m.start(), k, m.end()) for m in p.finditer(text) if len(m.group(g)) >= n)
            for k, (_, p, g, n) in enumerate(BASE)]


def test_base_spans_and_random_ones(spark, table_dir, frame):
    docs = frame([(i, t, "en", "s") for i, t in enumerate(TEXTS + PROSE)] + [(3, TEXTS[3], None, None), (None, "token=abcdef", None, None)])
    rows = QUERIES["op2_secret_scans"](spark, table_dir(documents=docs)).collect()
    assert len(rows) == len(TEXTS + PROSE) + 2
    for r in rows:
        if (r["doc_id"] or 0) >= len(TEXTS):
            assert r["spans"] == ""
            continue
        text = TEXTS[r["doc_id"]] if r["doc_id"] is not None else "token=abcdef"
        want = brute(text)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(w) for w in want], text
        base = [f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(x for w in want for x in w)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == base
        added = [s for s in spans if s.startswith("random")]
        if r["doc_id"] == TEXTS.index(f"see {RANDOM} here"):
            assert added == [f"random:4:{4 + len(RANDOM)}"]
        elif r["doc_id"] in (11, 12):
            assert not added


def test_model_separates_held_out_samples(spark, frame):
    words = ["configuration_manager", "internationalization", "document_repository", "characteristics", "the_quick_brown_fox"]
    model = secretscan.train(secretscan.labelled(frame([(i, w, "en", "s") for i, w in enumerate(words)])))
    table = spark.createDataFrame([(w, 0) for w in ("repository_document", "characterization", "configurations")]
                                  + [(hashlib.sha256(b"%d" % i).hexdigest()[:32], 1) for i in range(9000, 9050)],
                                  "token string, label int")
    got = table.select("label", (secretscan.ratio(table.token, model) > secretscan.LLR_MIN).alias("random")).collect()
    assert all(r["random"] == bool(r["label"]) for r in got)


def test_empty_table(spark, table_dir, frame):
    assert QUERIES["op2_secret_scans"](spark, table_dir(documents=frame([]))).count() == 0


def plain_samples(texts):
    """Labelled samples by the stated rule."""
    out = set()
    for text in map(lambda t: t or "", texts):
        out |= {(m.group(g), 1) for _, p, g, n in BASE for m in p.finditer(text) if len(m.group(g)) >= n}
        words = re.findall(r"[A-Za-z_-]{10,}", text)
        out |= {(w, 0) for w in words} | {(f"/{w}/", 0) for w in words}
    for i in range(secretscan.GENERATED):
        digest = hashlib.sha256(str(i).encode())
        b64 = base64.b64encode(digest.digest()).decode()
        out |= {(t, 1) for t in (digest.hexdigest()[:40], b64, re.sub("[^A-Za-z0-9]", "", b64).upper())}
    return out


def plain_model(samples):
    size, count = len(secretscan.ALPHABET) + 1, [Counter(), Counter()]
    for token, label in samples:
        count[label].update(zip(token, token[1:]))
    rows = [Counter(), Counter()]
    for c, r in zip(count, rows):
        for (a, _), n in c.items():
            r[a] += n

    def p(c, a, b):
        return (count[c][a, b] + secretscan.SMOOTHING) / (rows[c][a] + secretscan.SMOOTHING * size)

    return lambda t: sum(math.log(p(1, a, b) / p(0, a, b)) for a, b in zip(t, t[1:])) / (len(t) - 1)


IDENTIFIERS = ["see documentation/requirement/configuration now",
               "550e8400-e29b-41d4-a716-446655440000 or id=550E8400-e29b-41d4-a716-446655440000."]


def test_added_spans_against_plain_loops(spark, frame):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    mixed = []
    for _ in range(60):
        parts = ["".join(r.choices(letters, k=r.randint(10, 40))) for _ in range(r.randint(0, 4))]
        parts += r.choices(["token=abcdefgh", "configuration_documentation", "secret: " + "ab" * 20, "é🙂", "x" * 20,
                            "AKIA" + "Q7" * 10, "key_" + "0f" * 13], k=r.randint(0, 4))
        r.shuffle(parts)
        mixed.append(r.choice([" ", "\n", ".", ":"]).join(parts))
    texts = TEXTS + PROSE + IDENTIFIERS + mixed
    docs = frame([(i, t, "en", "s") for i, t in enumerate(texts)])
    samples = secretscan.labelled(docs)
    plain = plain_samples(texts)
    assert {tuple(x) for x in samples.collect()} == plain
    score = plain_model(plain)
    uuid = re.compile(r"([A-Za-z_-]+=)?[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
    n_added = 0
    for row in secretscan.scan(docs, secretscan.train(samples)).collect():
        text = texts[row["doc_id"]] or ""
        base = [(s, e) for found in brute(text) for s, _, e in found]
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text)
                if re.search("[A-Za-z]", m.group()) and not uuid.fullmatch(m.group())
                and score(m.group()) > secretscan.LLR_MIN
                and not any(s < m.end() and m.start() < e for s, e in base)]
        assert [(x["start"], x["end"]) for x in row[secretscan.ADDED]] == want, text
        assert text not in IDENTIFIERS or not want
        n_added += len(want)
    assert n_added > 40


def test_texts_of_very_many_spans_and_very_long_tokens(spark, table_dir, frame):
    n = 30_000
    texts = [f"token=abcdef {RANDOM} " * n, RANDOM * 25_000, "the interoperability " * 5] + PROSE
    rows = {r["doc_id"]: r for r in QUERIES["op2_secret_scans"](spark, table_dir(documents=frame(
        [(i, t, "en", "s") for i, t in enumerate(texts)]))).collect()}
    step = len(f"token=abcdef {RANDOM} ")
    assert rows[0]["n_assign"] == n
    assert rows[0]["spans"] == ",".join(f"assign:{i * step}:{i * step + 12},random:{i * step + 13}:{(i + 1) * step - 1}"
                                        for i in range(n))
    assert rows[1]["spans"] == f"random:0:{len(texts[1])}" and rows[2]["spans"] == ""
