"""Dense-vector column functions (X1-X7, E5, E9) as JVM higher-order functions, and the cosine of NumPy rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from bowline.functions.common import let

# --- fixed values: guards of the reference ---------------------------------
NORMALIZE_EPS = 1e-10   # unit-normalize / strict cosine: norm must exceed this
PROJECTION_ROW_EPS = 1e-8  # gaussian projection rows are scaled when norm exceeds this
# ---------------------------------------------------------------------------

VEC = "array<double>"


def as_double(v: Column) -> Column:
    return v.cast(VEC)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the common prefix (zip pads with NULL)."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))),
        F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(sq_norm(a))


def _check_dims(a: Column, b: Column, value: Column, what: str) -> Column:
    return F.when(F.size(a) != F.size(b),
                  F.raise_error(F.lit(f"{what}: different dimensions"))).otherwise(value)


def _cos_from(a: Column, b: Column, eps: float, strict: bool) -> Column:
    def body(s: Column) -> Column:
        na, nb = s["na"], s["nb"]
        ok = (na > eps) & (nb > eps) if strict else (na > 0.0) & (nb > 0.0)
        return F.when(ok, s["d"] / (na * nb)).otherwise(F.lit(0.0))
    return let(F.struct(dot(a, b).alias("d"), norm(a).alias("na"),
                        norm(b).alias("nb")), body)


def cosine(a: Column, b: Column) -> Column:
    """Strict cosine; 0.0 unless both norms exceed 1e-10; sizes must match."""
    return _check_dims(a, b, _cos_from(a, b, NORMALIZE_EPS, True), "cosine")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``cosine`` of the rows of two matrices."""
    na, nb = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b))
    ok = (na > NORMALIZE_EPS) & (nb > NORMALIZE_EPS)
    return np.where(ok, np.einsum("ij,ij->i", a, b) / np.where(ok, na * nb, 1.0), 0.0)


def cosine_lenient(a: Column, b: Column) -> Column:
    """Dot over the common prefix, full norms, guard norm > 0."""
    return _cos_from(a, b, 0.0, False)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance; sizes must match."""
    d = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                           F.lit(0.0), lambda acc, v: acc + v))
    return _check_dims(a, b, d, "distance")


def subtract(a: Column, b: Column) -> Column:
    """X5."""
    return _check_dims(a, b, F.zip_with(a, b, lambda x, y: x - y), "subtract")


def add(a: Column, b: Column) -> Column:
    """X6."""
    return _check_dims(a, b, F.zip_with(a, b, lambda x, y: x + y), "add")


def scale(a: Column, c: float | Column) -> Column:
    """X7."""
    c = c if isinstance(c, Column) else F.lit(float(c))
    return F.transform(a, lambda x: x * c)


def unit_normalize(a: Column) -> Column:
    """E5: divide by the norm when it exceeds 1e-10, else unchanged."""
    return let(a, lambda v: let(norm(v), lambda m: F.when(
        m > NORMALIZE_EPS, F.transform(v, lambda x: x / m)).otherwise(v)))


def dimension(a: Column) -> Column:
    """E9."""
    return F.size(a)


def rounded(a: Column, digits: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))
