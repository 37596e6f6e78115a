"""Aggregates and rounding that give the same digits on every plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding done on a decimal, so 1.005 gives 1.01; result is double.

    The decimal keeps 14 places, which also hides the last bits in which sums differ from
    plan to plan. Values it cannot hold are rounded as they are.
    """
    exact = F.round(value.try_cast("decimal(38,14)"), digits).cast("double")
    return F.coalesce(exact, F.round(value.cast("double"), digits))


def mean(value: Column) -> Column:
    """Average as sum/count: exact sums for decimal input, double result."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def ratio(top: Column, bottom: Column) -> Column:
    """Double quotient, null when the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return rounded(100 * ratio(part, whole), digits)


def total(value: Column) -> Column:
    """Sum, 0 over no rows."""
    return F.coalesce(F.sum(value), F.lit(0))
