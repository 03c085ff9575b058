"""Arithmetic with NULL as the one missing value.

ANSI mode raises on division by zero and NaN passes comparisons, so quotients are guarded and NaN never
enters a predicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, NULL where d is zero or missing."""
    return F.when(d != 0, n / d)


def signed_ratio(n: Column, d: Column) -> Column:
    """n / d as floating point hardware has it, but NULL for 0/0: infinite where only d is zero."""
    return F.when(d != 0, n / d).when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))


def known(x: Column) -> Column:
    """x with NaN as NULL, for data from outside."""
    return F.when(~F.isnan(x), x)


def rounded(x: Column, places: int) -> Column:
    """Rounded for comparison between engines; negative zero becomes zero."""
    return F.round(x, places) + F.lit(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def cut_bits(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 0..255 as a short, truncated; a constant band becomes 0."""
    scaled = (x - low) / (high - low) * 255
    return F.when(high > low, clip(scaled, 0.0, 255.0).cast("int")).when(high == low, F.lit(0)).cast("short")


def let(body: Callable[..., Column], **values: Column) -> Column:
    """body of values that are computed once: in a long formula each name would otherwise repeat its whole expression."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.element_at(F.transform(bound, lambda row: body(**{k: row[k] for k in values})), 1)
