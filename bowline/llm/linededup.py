"""Line deduplication by site-relative frequency.

Documents are grouped by host. A line's frequency on a host is the number of
the host's pages that contain it divided by the host's pages; a line above the
boilerplate ratio (and on at least ``min_pages`` pages) is dropped from every
page of that host. Lines are compared after trimming blanks; blank lines are
kept and never counted.

Counting is one aggregation over (host, line key) with map-side sums, so a hot
host or line arrives pre-summed. Line keys are 96 bits of two independent
hashes. Each host keeps fewer than (distinct lines per page / ratio) dropped
lines. Those lists are broadcast only if their counted size is under
``BROADCAST_BYTES``; beyond it they are joined on (host, salt), so one hot host
is spread over ``SALTS`` partitions. Everything is a DataFrame expression.

Nulls: a null host is a host of its own; a null text has no lines and stays
null. A page whose lines are all dropped stays, with an empty text. Repeated
rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bowline.functions.common import let
from bowline.llm.tables import ROW, materialize, packed

RATIO = 0.05
MIN_PAGES = 3
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
BLANKS = " \t\r\x0b\x0c"


def line_key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.hash(trimmed).alias("b"))


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) == ""


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def host_pages(docs: DataFrame, host_col: str) -> DataFrame:
    return docs.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("pages"))


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text",
                   ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, pages_with, pages) of the lines above the boilerplate ratio."""
    keys = F.array_distinct(F.transform(F.filter(lines_of(F.col(text_col)), lambda x: ~is_blank(x)), line_key))
    counted = (docs.select(F.col(host_col).alias("host"), F.explode(keys).alias("key"))
               .groupBy("host", "key").agg(F.count("*").alias("pages_with"))
               .filter(F.col("pages_with") >= min_pages))
    total = host_pages(docs, host_col)
    return (counted.alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
            .filter(F.col("pages_with") > F.lit(ratio) * F.col("pages"))
            .select("c.host", "key", "pages_with", "pages"))


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text",
               ratio: float = RATIO, min_pages: int = MIN_PAGES,
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row as ``_row`` with the kept text, its line count and its dropped lines."""
    frequent = materialize(frequent_lines(docs, host_col, text_col, ratio, min_pages), "lines")
    per_host = frequent.groupBy("host").agg(F.collect_list("key").alias("drop"))
    rows = docs.select(packed(docs), F.col(host_col).alias("h"), F.col(text_col).alias("t"))
    # 16 bytes a key, 64 more for a host's name and row
    small = frequent.count() * 16 + frequent.select("host").distinct().count() * 64 <= broadcast_bytes
    if small:
        joined = rows.join(F.broadcast(per_host), F.col("h").eqNullSafe(F.col("host")), "left")
    else:
        salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("s", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, F.col("h").eqNullSafe(F.col("host")) & (F.col("s") == F.col("salt")), "left")
    none = F.col("drop").isNull()
    judged = let(lines_of(F.col("t")), lambda lines: let(
        F.filter(lines, lambda x: is_blank(x) | ~F.array_contains(F.col("drop"), line_key(x))),
        lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), F.size(lines).cast("long").alias("n"),
                              (F.size(lines) - F.size(kept)).cast("long").alias("d"))))
    plain = F.struct(F.col("t").alias("text"),
                     F.coalesce(F.size(lines_of(F.col("t"))), F.lit(0)).cast("long").alias("n"),
                     F.lit(0).cast("long").alias("d"))
    out = F.when(none | F.col("t").isNull(), plain).otherwise(judged)
    return (joined.select(ROW, out.alias("j"))
            .select(ROW, F.col("j.text").alias("kept_text"),
                    F.when(F.col("j.n") < 0, 0).otherwise(F.col("j.n")).alias("n_lines"),
                    F.col("j.d").alias("n_dropped")))
