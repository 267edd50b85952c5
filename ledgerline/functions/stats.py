"""Small statistical expressions whose edge cases (constants, empty sets) need care."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(value: Column) -> Column:
    """Sum where the sum of nothing is zero."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def pair_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


# Simple aggregations by name; the median needs the rank operator and lives there.
AGGREGATIONS = ("sum", "mean", "count", "min", "max", "median")
SIMPLE = {
    "sum": total,
    "mean": F.avg,
    "count": lambda v: F.count(v).cast("double"),
    "min": F.min,
    "max": F.max,
}
