"""Number parsing, guarded ratios and null-free sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(col: Column) -> Column:
    """As double; text that is no number becomes null."""
    return col.try_cast("double")


def total(col: Column) -> Column:
    """Sum, 0 where there is nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0).cast("double"))


def whole(col: Column) -> Column:
    """Sum cut to a whole number, 0 where there is nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def percent(num: Column, den: Column) -> Column:
    return ratio(num, den) * 100


def half_even(col: Column, digits: int | None) -> Column:
    """Round half to even, or leave as is when `digits` is None."""
    return col if digits is None else F.bround(col, digits)
