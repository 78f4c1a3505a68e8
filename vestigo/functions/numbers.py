"""Numeric helpers whose results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rnd(c: Column, places: int) -> Column:
    """Half-up rounding on the decimal value (12 digits kept), returned as double."""
    return F.round(c.cast("decimal(28,12)"), places).cast("double")


def exact_sum(c: Column) -> Column:
    """Sum as decimal: the same value whatever order the partial sums arrive in."""
    return F.sum(c.cast("decimal(28,12)")).cast("double")


def exact_avg(c: Column) -> Column:
    return exact_sum(c) / F.count(c)


def clamp(c: Column, low: float, high: float) -> Column:
    """Value brought into a range; null stays null, which greatest and least alone would not keep."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def safe_double(c: Column, default: float = 0.0) -> Column:
    """Malformed or missing numbers become the default, never an error."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def norm_conf(c: Column) -> Column:
    """Confidence given as 0-1 or 0-100, brought to 0-1."""
    v = safe_double(c)
    return clamp(F.when(v > 1.0, v / 100.0).otherwise(v), 0.0, 1.0)


def ratio(num: Column, den: Column) -> Column:
    """num/den, 0 where the denominator is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))
