"""Pixel kernels as relational expressions, for pictures held as arrays in one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two pictures."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")))


def quarter_sads(a: Column, b: Column, side: int) -> list[Column]:
    """The sums of the quarters of square pictures of ``side``: upper left, upper right, lower left, lower right."""
    half = side // 2
    apart = F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long"))
    at = lambda i: F.floor(i / half / side) * 2 + F.pmod(F.floor(i / half), F.lit(2))
    inside = lambda k: lambda x, i: at(i) == k
    return [_sum(F.filter(apart, inside(k))) for k in range(4)]


def dev(a: Column) -> Column:
    """Sum of absolute differences to the floored mean."""
    mean = lambda v: F.floor(_sum(F.transform(v, lambda x: x.cast("long"))) / F.size(v))
    return F.get(F.transform(F.array(F.struct(a.alias("v"), mean(a).alias("m"))), lambda s: _sum(F.transform(s["v"], lambda x: F.abs(x - s["m"]).cast("long")))), F.lit(0))


def clamp_pad(a: Column, width: int, height: int, edge: int) -> Column:
    """The picture with ``edge`` more pixels on every side, each the nearest of the picture."""
    across = width + 2 * edge
    near = lambda i, size: F.greatest(F.lit(0), F.least(i - edge, F.lit(size - 1)))
    places = F.sequence(F.lit(0), F.lit(across * (height + 2 * edge) - 1))
    return F.transform(places, lambda i: F.get(a, (near(F.floor(i / across), height) * width + near(F.pmod(i, F.lit(across)), width)).cast("int")))


def median(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def repeats(vectors: Column) -> Column:
    """For each vector of an array, whether an earlier one equals it."""
    return F.transform(vectors, lambda v, i: F.array_contains(F.slice(vectors, F.lit(1), i), v))
