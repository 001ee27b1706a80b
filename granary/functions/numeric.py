"""Column functions over numbers."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid(c: Column) -> Column:
    """Of the value held within 40 of zero."""
    return 1.0 / (1.0 + F.exp(-clamp(c, -40.0, 40.0)))


def scaled(c: Column, low: Column | float, high: Column | float) -> Column:
    """Where a value lies between two bounds, 0 to 1; 0 where they are equal."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(high == low, 0.0).otherwise((F.greatest(low, F.least(high, c)) - low) / (high - low))


def minmax(c: Column | str, *keys: str) -> Column:
    """Min-max within a key; 1 where all values are equal."""
    w = Window.partitionBy(*keys)
    c = F.col(c) if isinstance(c, str) else c
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, 1.0).otherwise((c - low) / (high - low))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Within -1 and 1; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, clamp(dot(a, b) / n, -1.0, 1.0))
