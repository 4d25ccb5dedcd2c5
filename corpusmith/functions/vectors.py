"""Vector columns (arrays of numbers) without UDFs. Every function is null for a null vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def inner_distance(a: Column, b: Column) -> Column:
    """One less the dot product: the cosine distance of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null where a side has no length."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def masked_mean(states: Column, mask: Column) -> Column:
    """The mean of the vectors of an array whose mask is 1; zeros where none is."""
    kept = F.filter(F.zip_with(states, mask, lambda h, m: F.when(m == 1, h)), lambda h: h.isNotNull())
    zero = F.transform(F.element_at(states, 1), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
