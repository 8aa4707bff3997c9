"""Reproducible random draws as pure functions of a key (survey §2.4).

A draw never depends on partitioning, retries or row order: it is read from
the MD5 of ``seed|purpose|ids...``. The same formulas are written in SQL for
the DuckDB oracle (``*_sql`` helpers), so both engines draw equal numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from bowline.functions.common import let

TWO_32 = float(2 ** 32)


def key(seed: int, purpose: str, *ids: Column) -> Column:
    parts = [F.lit(str(seed)), F.lit(purpose)] + [c.cast("string") for c in ids]
    return F.concat_ws("|", *parts)


def hash_word(k: Column, j: int = 0) -> Column:
    """The j-th 32-bit word of md5(key) as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(k), 1 + 8 * j, 8), 16, 10).cast("bigint")


def uniform(k: Column) -> Column:
    """u in [0, 1)."""
    return hash_word(k, 0) / F.lit(TWO_32)


def normal(k: Column) -> Column:
    """Standard normal by Box-Muller on the first two words of the hash, which is taken once."""
    def word(h: Column, j: int) -> Column:
        return F.conv(F.substring(h, 1 + 8 * j, 8), 16, 10).cast("bigint")

    return let(F.md5(k), lambda h: F.sqrt(F.lit(-2.0) * F.log((word(h, 0) + 1) / F.lit(TWO_32 + 1)))
               * F.cos(F.lit(2 * math.pi) * word(h, 1) / F.lit(TWO_32)))


# ---- the same draws over the words of many keys (``md5.md5_words``) -----------

def uniform_array(words: np.ndarray) -> np.ndarray:
    return words[:, 0] / TWO_32


def normal_array(words: np.ndarray) -> np.ndarray:
    return (np.sqrt(-2.0 * np.log((words[:, 0].astype(np.float64) + 1) / (TWO_32 + 1)))
            * np.cos(2 * math.pi * words[:, 1] / TWO_32))


# ---- SQL twins (DuckDB dialect) for the oracle ------------------------------

def key_sql(seed: int, purpose: str, *ids: str) -> str:
    parts = [f"'{seed}'", f"'{purpose}'"] + [f"CAST({i} AS VARCHAR)" for i in ids]
    return "concat_ws('|', " + ", ".join(parts) + ")"


def hash_word_sql(k: str, j: int = 0) -> str:
    return f"CAST('0x' || substr(md5({k}), {1 + 8 * j}, 8) AS BIGINT)"


def uniform_sql(k: str) -> str:
    return f"({hash_word_sql(k, 0)} / {TWO_32!r})"


def normal_sql(k: str) -> str:
    h0 = hash_word_sql(k, 0)
    h1 = hash_word_sql(k, 1)
    return (f"(sqrt(-2.0 * ln(({h0} + 1) / {TWO_32 + 1!r})) * "
            f"cos({2 * math.pi!r} * {h1} / {TWO_32!r}))")
