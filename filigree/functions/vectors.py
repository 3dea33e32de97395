"""Column expressions over ``array<double>`` vectors; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm2(a: Column) -> Column:
    return total(F.transform(a, lambda x: x * x))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def between(a: Column, b: Column, u: Column) -> Column:
    """The point at share ``u`` of the way from ``a`` to ``b``."""
    return F.zip_with(a, b, lambda x, y: x + u * (y - x))


def clamp(u: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), u))


def edge_share(x: Column, a: Column, b: Column) -> Column:
    """Where ``x`` falls on the line from ``a`` to ``b``: 0 at ``a``, 1 at ``b``, unclamped; 0 for an edge without length."""
    length = sqdist(a, b)
    return F.when(length > 0, dot(minus(x, a), minus(b, a)) / length).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(norm2(a) * norm2(b))


def crossing(a1: Column, a2: Column, b1: Column, b2: Column) -> tuple[Column, Column]:
    """Where the lines through two pairs of plane points meet; infinity where they are parallel."""
    ax, ay, bx, by = a2[0] - a1[0], a2[1] - a1[1], b2[0] - b1[0], b2[1] - b1[1]
    cross = ax * by - ay * bx
    t = ((b1[0] - a1[0]) * by - (b1[1] - a1[1]) * bx) / F.nullif(cross, F.lit(0.0))
    far = F.lit(float("inf"))
    return F.coalesce(a1[0] + t * ax, far), F.coalesce(a1[1] + t * ay, far)


def is_between(a: Column, b: Column, c: Column) -> Column:
    """Whether the foot of ``c`` lies within the segment from ``a`` to ``b``."""
    d = dot(minus(c, a), minus(b, a))
    return (d >= 0) & (d <= sqdist(a, b))


def random_sign(seed: int) -> Column:
    return F.when(F.rand(seed) < 0.5, 1).otherwise(-1)
