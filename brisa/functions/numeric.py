"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_published(aqi: Column) -> Column:
    """Stored scale 0-4 to published scale 1-5."""
    return aqi + 1


def to_stored(aqi: Column) -> Column:
    """Published scale 1-5 to stored scale 0-4."""
    return aqi - 1


def without_nan(value: Column) -> Column:
    """NaN stands for a missing value in the source data, so treat it as null."""
    return F.when(~F.isnan(value), value)


def varies(value: Column) -> Column:
    """Aggregate: whether the values differ.

    Partial deviations of equal values can merge to a tiny number instead of 0,
    so a deviation must not be compared with 0.
    """
    return F.min(value) < F.max(value)


def safe_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null if either is constant."""
    x = F.when(b.isNotNull(), a)
    y = F.when(a.isNotNull(), b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(a, b) / F.when(varies(x) & varies(y), spread)


def hash_order(*keys: Column, seed: int = 42) -> Column:
    """Arithmetic hash of integer keys, the same in every engine and partitioning."""
    prime = F.lit(2147483647).cast("bigint")
    total = F.lit(seed).cast("bigint")
    for multiplier, key in zip((7919, 104729, 1299709), keys):
        total = total + F.pmod(key.cast("bigint"), prime) * multiplier
    return F.pmod(F.pmod(total, prime) * F.lit(1103515245).cast("bigint") + 12345, prime)
