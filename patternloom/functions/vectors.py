"""Arithmetic on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def total(a: Column) -> Column:
    """The sum of an array, 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """`a` at length one; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def z_normalised(a: Column) -> Column:
    """`a` less its mean over its population deviation; a constant array becomes zeros."""
    mean = total(a) / F.size(a)
    sd = F.sqrt(total(F.transform(a, lambda x: (x - mean) * (x - mean))) / F.size(a))
    return F.transform(a, lambda x: (x - mean) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))


def doubles(a: Column) -> Column:
    """An array of any number type as doubles."""
    return F.transform(a, lambda x: x.cast("double"))


def entropy(p: Column) -> Column:
    """Of an array of probabilities, in nats, each floored at 1e-12 inside the logarithm."""
    return -total(F.transform(p, lambda x: x * F.log(F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-12)))))


def uniform(seed: int, *keys: Column) -> Column:
    """A draw from [0, 1) that depends on the seed and the keys alone, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw by Box and Muller."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, *keys)))
    return radius * F.cos(2 * F.pi() * uniform(seed + 7919, *keys))
