"""Vector arithmetic as Column expressions; all sums are in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to norms, and the least scale.
EPS = 1e-8
#: Standard deviations below this count as 1.
STD_FLOOR = 1e-6


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Iterable[float]) -> Column:
    """A constant vector, parsed at once rather than built entry by entry."""
    texts = (f"{x!r}D" if math.isfinite(x) else f"double('{x}')" for x in map(float, values))
    return F.expr(f"cast(array({', '.join(texts)}) as array<double>)")


def block(v: Column, offset: int, dim: int) -> Column:
    """`dim` entries from the 0-based offset."""
    return F.slice(v, offset + 1, dim)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine, with EPS added to each norm, so a zero vector is at distance 1 from all."""
    return F.lit(1.0) - dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


METRICS = {"l1": l1, "l2": l2, "cosine": cosine}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def unit(v: Column) -> Column:
    n = norm(v) + EPS
    return F.transform(v, lambda x: x / n)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def similarity(d: Column) -> Column:
    return 1 / (1 + d)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mindist(q: Column, low: Column, high: Column) -> Column:
    """Euclidean distance of a point to a box, 0 inside."""
    below = F.zip_with(low, q, lambda lo, x: F.greatest(lo - x, F.lit(0.0)))
    above = F.zip_with(q, high, lambda x, hi: F.greatest(x - hi, F.lit(0.0)))
    return norm(F.zip_with(below, above, lambda a, b: a + b))


def renormalised(v: Column) -> Column:
    """Negatives cut to 0, then divided by the sum; left alone when that is 0."""
    cut = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    s = total(cut)
    return F.when(s > 0, F.transform(cut, lambda x: x / s)).otherwise(cut)


def moments(v: Column) -> Column:
    """mean, std (population), skew with 1e-6 added to the cubed deviation, kurtosis likewise with the fourth power."""
    n = F.size(v)
    mean = total(v) / n
    power = lambda k: total(F.transform(v, lambda x: F.pow(x - mean, F.lit(k)))) / n
    std = F.sqrt(power(2.0))
    return F.struct(mean.alias("mean"), std.alias("std"), (power(3.0) / (F.pow(std, F.lit(3.0)) + 1e-6)).alias("skew"), (power(4.0) / (F.pow(std, F.lit(4.0)) + 1e-6)).alias("kurtosis"))


def cumulative(v: Column) -> Column:
    """Running sums divided by the number of entries."""
    n = F.size(v)
    return F.transform(v, lambda _, i: total(F.slice(v, F.lit(1), (i + 1).cast("int"))) / n)
