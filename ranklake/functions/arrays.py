"""Ranked lists and vectors held in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def head(a: Column, k: int | Column) -> Column:
    return F.slice(a, 1, k)


def overlap_at(a: Column, b: Column, k: int) -> Column:
    """Shared items of the first k, over k even for shorter lists."""
    return F.size(F.array_intersect(head(a, k), head(b, k))) / F.lit(float(k))


def position(a: Column, item: Column) -> Column:
    """Zero-based place, null where absent."""
    return F.nullif(F.array_position(a, item), F.lit(0)) - 1


def rbo(a: Column, b: Column, k: int, p: float = 0.9) -> Column:
    """Rank-biased overlap to depth k with the tail extrapolated from the agreement at k. 1 for equal lists of k or more."""
    share = lambda d: F.size(F.array_intersect(head(a, d), head(b, d))) / d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, d: acc + share(d) * F.pow(F.lit(p), d - 1))
    return total * (1 - p) + share(F.lit(k)) * F.lit(p**k)


def rbo_archived(a: Column, b: Column, k: int, p: float = 0.9) -> Column:
    """The counter that archived tables used: an item that both lists hold at the same depth adds nothing."""
    at = lambda d: F.get(a, d - 1).eqNullSafe(F.get(b, d - 1)) & F.get(a, d - 1).isNotNull()
    shared = lambda d: F.size(F.array_intersect(head(a, d), head(b, d)))
    same = lambda d: F.aggregate(F.sequence(F.lit(1), d), F.lit(0), lambda acc, e: acc + F.when(at(e), 1).otherwise(0))
    share = lambda d: (shared(d) - same(d)) / d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, d: acc + share(d) * F.pow(F.lit(p), d - 1))
    return total * (1 - p) + share(F.lit(k)) * F.lit(p**k)


def first_wins_map(pairs: Column) -> Column:
    """Map of an array of (key, value) structs; of repeated keys the first counts."""
    keys = F.array_distinct(F.transform(pairs, lambda x: x["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(pairs, lambda x: x["key"] == k)[0]["value"]))


def lookup(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def strict_unit(a: Column) -> Column:
    """Scaled to length 1; raises for zero or non-finite vectors."""
    n = norm(a)
    good = (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(good, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("vector without a direction")).cast("array<double>"))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x))))
