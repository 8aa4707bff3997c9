import os
import random
import sys

import pytest

import corpus_pipeline as cp

from test_decontam import brute as brute_hits
from test_simhash import brute_components, brute_fp

WORDS = {"en": "the and of that with this from they have which".split(), "de": "der und nicht schön über mit dass für ich auch".split()}


@pytest.fixture
def corpus(spark, table_dir, frame):
    r = random.Random(8)
    item = " ".join("bench%d" % i for i in range(20))
    rows = []
    for i in range(90):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "x%d" % i]) for _ in range(r.randint(20, 60))), lang, r.choice("ab")))
    rows += [(100, rows[3][1], "en", "a"), (101, rows[4][1], "en", "b"), (102, None, "en", "a"), (103, "12 !!", "en", "a"),
             (104, rows[5][1] + " " + item, "en", "a"), (105, "the and " * 5000, "en", "b"), (7, rows[7][1], rows[7][2], rows[7][3]),
             (None, "they have this and that from which", None, None), (106, "", "en", "a")]
    d = table_dir(documents=frame(rows), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    return d, rows, item


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_stages_take_effect(spark, corpus):
    d, rows, item = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == cp.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs.collect()
    kept = {r["doc_id"] for r in out["language_id"]}
    assert not kept & {102, 103, 106} and kept >= set(range(90)) | {100, 101, 104, 105}
    # near duplicates: one row of each component of the brute-force links stays
    before = [r for r in out["line_dedup"]]
    fps = {n: brute_fp(r["text"]) for n, r in enumerate(before)}
    groups = set(brute_components(fps).values())
    after = out["simhash_near_dedup"]
    assert len(after) == len(groups)
    assert {100, 101}.isdisjoint(r["doc_id"] for r in after) and sum(r["doc_id"] == 7 for r in after) == 1
    clean = {r["doc_id"] for r in after if not brute_hits(r["text"], [(1, item)])[4]}
    assert {r["doc_id"] for r in out["benchmark_decontamination"]} == clean and 104 not in clean
    packed = cp.STAGES[-1][1](spark, docs, d).collect()
    assert {r["doc_id"] for r in packed} == clean


def test_run_is_the_stages_in_order(spark, corpus):
    d, _, _ = corpus
    got = cp.run(spark, d)
    assert set(got.columns) == {"doc_id", "piece", "first_word", "n_words", "bin_id"} and got.count() > 80


def test_empty_tables(spark, table_dir, frame):
    d = table_dir(documents=frame([]), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert cp.run(spark, d).count() == 0


def test_entry_registers_every_operator(spark):
    sys.path.insert(0, os.path.dirname(os.path.abspath(cp.__file__)))
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")} and "pipeline" in names


def test_language_id_rejects_unlearned_languages_and_random_strings(spark, frame):
    r = random.Random(3)
    made = lambda stems, ends: ["".join(p) for p in ((r.choice(stems), r.choice(stems), r.choice(ends)) for _ in range(400))]
    words = {"en": WORDS["en"] + made("th re on in ea st nd ou".split(), ["ing", "er", "ly", ""]),
             "de": WORDS["de"] + made("sch ei ge ver un ß ü ch".split(), ["en", "ung", "lich", ""])}
    say = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, r.randint(3, 400)), lang, "a") for i in range(900) for lang in [r.choice("en de".split())]]
    keep = [(2000 + i, say(lang, n), None, "a") for i, (lang, n) in enumerate(
        (lang, n) for lang in words for n in (3, 8, 60, 300, 3000, 60_000))]
    letters = "abcdefghijklmnopqrstuvwxyz"
    odd = ["Η γλώσσα είναι ένα σύστημα επικοινωνίας που χρησιμοποιούν οι άνθρωποι για να μιλούν. " * 8,
           "Язык это система знаков которая служит средством общения людей и выражения мыслей. " * 8,
           "语言是人类最重要的交际工具是人们进行沟通的主要表达方式" * 20, r.randbytes(500).hex(),
           "".join(r.choice(letters + letters.upper() + "0123456789+/") for _ in range(900)),
           " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(200))]
    odd += [t * 300 for t in odd[:3]]
    docs = frame(rows + keep + [(3000 + i, t, None, "a") for i, t in enumerate(odd)])
    kept = {x["doc_id"] for x in cp.language_id(spark, docs, "").select("doc_id").collect()}
    assert not {i for i in kept if i >= 3000}
    assert kept >= {i for i, *_ in keep}
    assert len([i for i in kept if i < 900]) >= 898
