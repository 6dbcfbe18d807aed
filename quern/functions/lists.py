"""Set operations on ordered lists of ids; the first occurrence keeps its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_distinct(ids: Column) -> Column:
    """Ids as text, without nulls and empty ones."""
    text = F.transform(ids, lambda x: x.cast("string"))
    return F.array_distinct(F.filter(text, lambda x: x.isNotNull() & (x != "")))


def union(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def lock_top(base: Column, fused: Column, n: int) -> Column:
    """The first ``n`` of ``base``, then ``fused``, then what is left of ``base``."""
    return F.array_distinct(F.concat(F.slice(base, 1, n), fused, base))


def overlap(a: Column, b: Column, n: int | None = None) -> Column:
    if n is not None:
        a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    return F.size(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def ensure_members(candidates: Column, required: Column, limit: int) -> Column:
    """At most ``limit`` candidates; required ids that the list lacks replace its
    tail (which may itself hold a required id). Fails if they alone exceed the limit."""
    missing = F.array_except(required, candidates)
    kept = F.slice(candidates, F.lit(1), F.greatest(F.lit(0), F.lit(limit) - F.size(missing)))
    fits = F.concat(kept, missing)
    return F.when(F.size(required) > limit, F.raise_error(F.lit("more required ids than the limit")).cast("array<string>")).otherwise(fits)
