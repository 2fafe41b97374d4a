"""Aggregates and rounding that agree with plain-Python statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, half to even; 0 where there is nothing."""
    return F.coalesce(F.bround(F.try_divide(F.lit(100.0) * part, whole), digits), F.lit(0.0))


def mean(total: Column, n: Column, digits: int = 1) -> Column:
    return F.coalesce(F.bround(F.try_divide(total.cast("double"), n), digits), F.lit(0.0))


def percentile(x: Column, q: float, where: Column | None = None) -> Column:
    """Exact, with linear interpolation; 0 for no rows. Rounded to 6 places, as the last bits depend on the engine."""
    value = F.percentile(x if where is None else F.when(where, x), F.lit(q))
    return F.coalesce(F.round(value, 6), F.lit(0.0))


def upper_median(values: Column) -> Column:
    """The middle element of a sorted array, the upper one of two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def exclusive_decile_90(values: Column) -> Column:
    """The ninth exclusive decile cut of an array, truncated; the maximum below ten values, 0 for none."""
    x, n = F.sort_array(values), F.size(values)
    j = F.least(F.greatest(F.floor(F.lit(9) * (n + 1) / 10).cast("int"), F.lit(1)), n - 1)
    delta = 9 * (n + 1) - 10 * j
    cut = (F.get(x, j - 1) * (10 - delta) + F.get(x, j) * delta) / 10
    return F.coalesce(F.when(n >= 10, F.floor(cut)).otherwise(F.array_max(values)), F.lit(0)).cast("bigint")


def decile_90_of(x: Column, n: int) -> Column:
    """The same as an aggregate over n whole numbers, n known beforehand; it holds counts by value, not the rows."""
    if n < 10:
        return F.coalesce(F.max(x), F.lit(0)).cast("bigint")
    j = min(max(9 * (n + 1) // 10, 1), n - 1)
    delta = 9 * (n + 1) - 10 * j
    element = lambda k: F.round(F.percentile(x, F.lit((k - 1) / (n - 1)))).cast("bigint")
    return F.floor((element(j) * (10 - delta) + element(j + 1) * delta) / 10).cast("bigint")
