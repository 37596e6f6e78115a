"""Tail probabilities of the F distribution, as a small vectorised helper."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    value = d
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + step / c
            c = c if abs(c) > floor else floor
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_fraction(a, b, x) / a
    return 1.0 - front * _continued_fraction(b, a, 1.0 - x) / b


def f_tail(f: float, df1: float, df2: float) -> float | None:
    """P(F > f), or None where an argument is missing or out of range."""
    if any(v is None or math.isnan(v) for v in (f, df1, df2)) or df1 <= 0 or df2 <= 0:
        return None
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * max(f, 0.0)))


def _tails(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(*row) for row in zip(f, df1, df2)], dtype="float64")


def f_pvalue(f: Column, df1: Column, df2: Column) -> Column:
    """Column form of :func:`f_tail`; meant for the one row of a test result."""
    return F.pandas_udf(_tails, "double")(f, df1, df2)
