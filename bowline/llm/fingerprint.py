"""Document fingerprints: one-permutation MinHash with optimal densification.

Every word shingle is hashed once; the hash's top bits name one of ``BINS``
bins and each bin keeps its minimum. An empty bin takes the value of a
non-empty one chosen by its own hashed order of all bins (the first non-empty
bin of that order), so equal sets densify alike and unequal ones
independently. The fingerprint stores the low ``8`` bits of each bin as hex.
The likeness of two fingerprints is the share of equal bins, corrected for the
2**-8 chance that unlike bins agree.

All of it is DataFrame expressions inside the row: sorting a text's hashes
groups them by bin, and the first of each run is the bin's minimum.

``with_next`` finds each document's successor in descending id order without a
global window: quantiles of the ids (a bounded number of longs) cut them into
ranges, each range is one window partition, and the largest id of a range is
also sent to the end of the next one. The texts move once.

Nulls: a null text is empty. A text without words has an empty fingerprint; two
of them have likeness 1, one of them and another text 0. Null ids come after
all others; equal ids are ordered by text. Where no id is known the last
document's successor is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bowline.functions.common import let

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
KEPT_BITS = 8
RANGE_ROWS = 512
MAX_RANGES = 65_536
BLANKS = " \t\n\r\x0b\x0c"


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Sorted hashes of the word shingles of a text; fewer words are one shingle, none are none."""
    trimmed = F.btrim(F.lower(text), F.lit(BLANKS))
    return let(F.split(trimmed, r"[ \t\n\x0B\f\r]+"), lambda w: F.when(
        F.element_at(w, 1) == "", F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice(w, i, shingle))))))


def bin_of(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS)


def kept(h: Column) -> Column:
    """The low bits of a hash, as a signed byte."""
    return (h.bitwiseAND((1 << KEPT_BITS) - 1) - (1 << (KEPT_BITS - 1))).cast("tinyint")


def bits(text: Column) -> Column:
    """array<tinyint>: the kept low bits of every bin; empty for a text without words."""
    def first_of_runs(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))

    def dense(least: Column) -> Column:
        low = F.transform(least, kept)
        return let(F.map_from_arrays(F.transform(least, bin_of), low), lambda held: F.transform(
            F.sequence(F.lit(-BINS // 2).cast("bigint"), F.lit(BINS // 2 - 1).cast("bigint")),
            lambda j: F.coalesce(F.element_at(held, j), F.array_min(F.transform(
                least, lambda v: F.struct(F.xxhash64(j, bin_of(v)), kept(v).alias("v"))))["v"])))

    return let(let(shingle_hashes(text), first_of_runs), lambda least: F.when(
        F.size(least) == 0, F.array().cast("array<tinyint>")).otherwise(dense(least)))


def as_hex(b: Column) -> Column:
    digits = F.transform(b, lambda v: F.substring(
        F.hex(v.cast("int") + (1 << (KEPT_BITS - 1)) + (1 << KEPT_BITS)), 2, 2))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0 ** -KEPT_BITS
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
            .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .otherwise(F.greatest((equal - chance) / (1 - chance), F.lit(0.0))))


def _literal(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame, id_col: str, carried: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` with ``next_<c>`` of the following row, ids descending; after the last comes the first."""
    n, top = docs.agg(F.count("*"), F.max(id_col)).first()
    if top is None:
        w = Window.partitionBy(F.xxhash64(*carried[:1])).orderBy(*carried[:1])
        return docs.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    ranges = min(max(1, -(-n // range_rows)), MAX_RANGES)
    cuts = docs.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)] or [0.5],
                                        max(10_000, 4 * ranges))).first()[0]
    bounds = sorted({*(c for c in cuts if ranges > 1), top})
    edges, steps = _literal(bounds), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    x = F.col(id_col)
    # number of bounds below the id, by binary search
    below = F.aggregate(_literal(steps).cast("array<int>"), F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(edges, at + step - 1) < x), at + step).otherwise(at))
    placed = docs.withColumn("_range", below)
    following = F.when(x == F.lit(top), 0).when(x == F.get(edges, F.col("_range")), F.col("_range") + 1)
    placed = placed.select("*", F.explode(F.array_compact(F.array(
        F.struct(F.col("_range").alias("at"), F.lit(0).alias("copy")),
        F.when(following.isNotNull(), F.struct(following.alias("at"), F.lit(1).alias("copy")))))).alias("_to"))
    w = Window.partitionBy("_at").orderBy("_copy", x.desc_nulls_last(), *carried[:1])
    return (placed.withColumns({"_at": F.col("_to.at"), "_copy": F.col("_to.copy")})
            .withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
            .filter("_copy = 0").drop("_range", "_to", "_at", "_copy"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, bits) with null texts empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
            .withColumn("bits", bits(F.col("text"))))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has the last third of its code points (rounded down)
    replaced by as many from the start of the next document.
    """
    paired = with_next(fingerprints(docs, id_col, text_col), "doc_id", ["text", "bits"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    out = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "bits",
                        F.coalesce("next_bits", F.array().cast("array<tinyint>")).alias("next_bits"))
    out = out.withColumn("edited_bits", bits(F.col("edited")))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      as_hex(F.col("bits")).alias("fingerprint"),
                      as_hex(F.col("edited_bits")).alias("edited_fingerprint"),
                      likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
                      likeness(F.col("bits"), F.col("next_bits")).alias("near_next"))
