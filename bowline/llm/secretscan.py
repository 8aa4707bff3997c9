"""Secret scans: fixed rules, and character Markov models compared by likelihood.

Rules (``KINDS``) give base spans, leftmost and non-overlapping per kind. The
method adds spans of kind ``random``: a candidate token is scored under two
first-order character Markov models, one of random strings and one of ordinary
identifiers, and is reported where the mean log-likelihood ratio of its
transitions exceeds ``LLR_MIN``. Candidates that touch a base span are left to
it; tokens of digits only (numbers, cards) and UUIDs, alone or after a name
and ``=``, are identifiers by their form and no candidates.

Training. Labelled samples: label 1 are the values that the rules find in the
corpus and ``GENERATED`` hashed strings in hex, base64 and upper case; label 0
are the distinct words and identifiers of ``ORDINARY`` in the corpus, each as
it is and between slashes, as in a path. Counting is one aggregation by
character pair; the model is a table of at most (alphabet + 1)**2 ratios, sent
as a literal.

Everything is DataFrame expressions. Positions are code points, end exclusive;
they are running sums of the lengths of matches and of the pieces between
them, taken in blocks of ``BLOCK``. A candidate touches a base span where more
base spans start before its end than end by its start, which two binary
searches tell.

Nulls: a null text is empty and has no spans. Very long texts and texts of
very many spans: work grows with the characters, plus a factor of ``BLOCK`` in
the running sums only. Repeated rows and ids: every row is scanned by itself;
of equal samples one is learned from. Without any sample in the corpus the
generated ones alone are label 1, and label 0 is uniform.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bowline.functions.common import let

# fixed values: kind -> (pattern, group that must have the length, length)
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 and more: the runs of one and more that are long enough
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
ADDED = "random"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z_-]{10,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
UUID = "^([A-Za-z_-]+=)?[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
GENERATED = 2000
LLR_MIN = 0.5
SMOOTHING = 0.5
BLOCK = 128

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def running(steps: Column) -> Column:
    """Running sums of a non-empty array of ints, bound by ``let``: inside blocks, then over the blocks."""
    def sums(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda acc, v: F.concat(
            acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + v)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
                         lambda i: sums(F.slice(steps, i * BLOCK + 1, BLOCK)))
    return let(blocks, lambda b: let(sums(F.transform(b, F.array_max)), lambda before: F.flatten(F.transform(
        b, lambda x, i: let(F.coalesce(F.get(before, i - 1), F.lit(0)), lambda at: F.transform(
            x, lambda v: v + at))))))


def _placed(text: Column, pattern: str, keep, rank: int, kind: str) -> Column:
    """Spans of all matches of ``pattern`` for which ``keep(match)`` holds."""
    def walk(m: Column) -> Column:
        size = F.transform(m, F.length)
        steps = F.zip_with(size, F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(m)),
                           lambda a, b: a + b)
        spans = let(let(steps, running), lambda ends: F.transform(m, lambda v, i: F.struct(
            (F.get(ends, i) - F.length(v)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"),
            F.when(keep(v), F.lit(kind)).alias("kind"))))
        return F.filter(spans, lambda s: s["kind"].isNotNull())

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(
        F.size(m) > 0, walk(m)).otherwise(F.array().cast(SPANS)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    if not group:
        return _placed(text, pattern, lambda m: F.length(m) >= least, rank, kind)
    return _placed(text, pattern, lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least, rank, kind)


def _values(text: Column) -> Column:
    """The secret values that the rules find."""
    def of(pattern: str, group: int, least: int) -> Column:
        found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.length(v) >= least)
        return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(*rule) for rule in KINDS.values()])


def generated(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """Random strings by rule: hashes of 0..n-1 in hex, base64 and upper case letters and digits."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""))
    return spark.range(n).select(F.explode(F.array(
        F.substring(digest, 1, 40), F.base64(F.unhex(digest)), upper)).alias("token"))


def labelled(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, label): distinct labelled samples from the whole corpus and the generated ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.explode(F.concat(
        F.transform(_values(text), lambda v: F.struct(v.alias("token"), F.lit(1).alias("label"))),
        F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0)), lambda v: F.array(
            F.struct(v.alias("token"), F.lit(0).alias("label")),
            F.struct(F.concat(F.lit("/"), v, F.lit("/")).alias("token"), F.lit(0).alias("label"))))))).alias("s"))
    return found.select("s.token", "s.label").union(
        generated(docs.sparkSession).select("token", F.lit(1).alias("label"))).distinct()


def _at(c: Column) -> Column:
    """Position of a character in the alphabet from 1; 0 for any other."""
    return F.instr(F.lit(ALPHABET), c)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of every character transition."""
    size = len(ALPHABET) + 1
    pair = F.explode(let(F.transform(F.split("token", ""), _at), lambda c: F.transform(
        F.slice(c, 2, F.size(c) - 1), lambda v, i: F.get(c, i) * size + v)))
    counts = (samples.filter(F.length("token") > 1).select("label", pair.alias("pair"))
              .groupBy("label", "pair").agg(F.count("*").alias("n")).collect())
    n = [[0.0] * (size * size) for _ in range(2)]
    for r in counts:
        n[r["label"]][r["pair"]] = float(r["n"])
    def log_p(c: list[float], a: int, b: int, row: float) -> float:
        return math.log((c[a * size + b] + SMOOTHING) / (row + SMOOTHING * size))
    rows = [[sum(c[a * size:(a + 1) * size]) for a in range(size)] for c in n]
    return [log_p(n[1], a, b, rows[1][a]) - log_p(n[0], a, b, rows[0][a]) for a in range(size) for b in range(size)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    size = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{v:.6f}" for v in model)), ",").cast("array<double>")
    def mean(c: Column) -> Column:
        pairs = F.transform(F.slice(c, 2, F.size(c) - 1), lambda v, i: F.get(c, i) * size + v)
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.get(table, p)) / (F.size(c) - 1)

    return let(F.transform(F.split(token, ""), _at), mean)


def _below(values: Column, x: Column) -> Column:
    """Number of values of a sorted array that are less than ``x``, by binary search."""
    steps = F.lit(",".join(str(1 << i) for i in reversed(range(31))))
    return F.aggregate(F.split(steps, ",").cast("array<int>"), F.lit(0), lambda at, step: F.when(
        (step <= F.size(values) - at) & (F.get(values, at + step - 1) < x), at + step).otherwise(at))


def added_spans(text: Column, model: list[float], base: Column) -> Column:
    """Spans of candidate tokens that look random and touch no base span."""
    spans = _placed(text, CANDIDATE, lambda m: m.rlike("[A-Za-z]") & ~m.rlike(UUID) & (ratio(m, model) > LLR_MIN),
                    len(KINDS), ADDED)
    edges = F.struct(F.sort_array(F.transform(base, lambda b: b["start"])).alias("starts"),
                     F.sort_array(F.transform(base, lambda b: b["end"])).alias("ends"))
    return let(edges, lambda e: F.filter(
        spans, lambda s: _below(e["starts"], s["end"]) == _below(e["ends"], s["start"] + 1)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, assign, access, hex, random): spans of every kind for every row."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumns({k: base_spans(F.col("text"), k) for k in KINDS})
    out = out.withColumn(ADDED, added_spans(F.col("text"), model, reduce(F.concat, map(F.col, KINDS))))
    return out.drop("text")
