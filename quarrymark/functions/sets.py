"""Set similarity on string arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|; two empty sets are equal (1.0)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(part: Column, whole: Column) -> Column:
    """Share of ``part`` found in ``whole``; an empty part gives 0.0."""
    n = F.size(F.array_distinct(part))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / n)


def term_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of both containments; NULL when both sets are empty."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total)


def prefix_variant(a: Column, b: Column, at_least: int = 4) -> Column:
    """Equal terms, or one a prefix of the other with at least ``at_least`` letters and no digits."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a == b) | ((F.length(short) >= at_least) & ~short.rlike(r"^\d+$") & long.startswith(short))
