"""Array / numeric column expressions.

Vectors are ``array<float|double>`` columns keyed by an id; all maths stays in
JVM higher-order functions, so no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _col(c).cast("array<double>")


def lit_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def sq_euclidean(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b),
                                  lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a, b) -> Column:
    """Euclidean distance."""
    return F.sqrt(sq_euclidean(a, b))


def cosine(a, b) -> Column:
    """Cosine similarity (0 when either vector is all zeros)."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def normalize(a) -> Column:
    n = norm(a)
    return F.when(n == 0, as_double_array(a)).otherwise(
        F.transform(as_double_array(a), lambda x: x / n))


def argmax(a) -> Column:
    """0-based index of the largest element, lowest index on ties."""
    a = _col(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a) -> Column:
    a = _col(a)
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def softmax(a) -> Column:
    """Numerically stable softmax (max shift)."""
    x = as_double_array(a)
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / s)


def sigmoid(x) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x).cast("double")))


def threshold_predict(p, t: float = 0.5) -> Column:
    """Strict ``p > t`` as 0/1."""
    return (_col(p) > F.lit(t)).cast("int")
