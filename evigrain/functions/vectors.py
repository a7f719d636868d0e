"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """The vector divided by its length, as float; a zero or non-finite length is an error."""
    m = magnitude(v)
    bad = F.isnan(m) | (m == 0) | (m == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("vector magnitude must be finite and not zero")).cast("double")).otherwise(m)
    return F.transform(v, lambda x: (x.cast("double") / checked).cast("float"))


def sigmoid(x: Column) -> Column:
    """Logistic function by the branch that can't overflow; null for a logit that isn't finite."""
    finite = ~(F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(finite & (x >= 0), 1 / (1 + F.exp(-x))).when(finite, F.exp(x) / (1 + F.exp(x)))
