"""Rounding, safe ratios and clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int = 2) -> Column:
    """Round to ``digits`` places, halves to the even neighbour, as a double: data frames."""
    scale = float(10**digits)
    return F.rint(c.cast("double") * scale) / F.lit(scale)


def half_away(c: Column, digits: int = 2) -> Column:
    """Round to ``digits`` places, halves away from zero, as a double: SQL's ROUND."""
    scale, c = float(10**digits), c.cast("double")
    rounded = F.floor(F.abs(c) * scale + 0.5).cast("double") / F.lit(scale)
    return F.when(c < 0, -rounded).otherwise(rounded) + 0.0  # no negative zero


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, NULL when the denominator is zero or missing."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def avg_exact(c: Column) -> Column:
    """Average whose sum does not depend on row order: the sum is a decimal."""
    return ratio(F.sum(c), F.count(c))


def upper_clip(c: Column, bound: float | Column) -> Column:
    """Cap above; NULL stays NULL."""
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    return F.when(c > bound, bound).otherwise(c)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Cap on both sides; NULL stays NULL (C11)."""
    return F.when(c < low, low).when(c > high, high).otherwise(c)
