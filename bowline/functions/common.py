"""Small expression helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding).

    Spark SQL has no LET; a transform over a one-element array binds the
    value to a lambda variable, so an expensive sub-expression that the body
    uses several times is computed once per row.
    """
    return F.transform(F.array(value), body).getItem(0)
