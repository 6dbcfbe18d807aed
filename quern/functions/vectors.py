"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-12) -> Column:
    size = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / size)


def mean_pool(vectors: Column, width: int) -> Column:
    """Mean of an array of vectors, as a unit vector."""
    zero = F.array(*[F.lit(0.0)] * width)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    n = F.greatest(F.size(vectors), F.lit(1))
    return unit(F.transform(total, lambda x: x / n))


def relevance(logits: Column) -> Column:
    """One logit: itself; two: the difference; more: the largest."""
    return F.when(F.size(logits) == 1, F.get(logits, 0)).when(F.size(logits) == 2, F.get(logits, 1) - F.get(logits, 0)).otherwise(F.array_max(logits))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
