"""Small joins several analyses share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.model import Warehouse


def with_employee(facts: DataFrame, wh: Warehouse, *columns: str, how: str = "inner") -> DataFrame:
    """Add directory columns by ``user_email``.

    No broadcast hint: the directory grows with the organisation, so the choice is
    left to Spark's size estimates and, at run time, to adaptive execution. Callers
    aggregate facts per user first wherever the result allows it.
    """
    directory = wh.employees.select(F.col("email").alias("_email"), *columns)
    joined = facts.join(directory, F.col("user_email") == F.col("_email"), how)
    return joined.drop("_email")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row frames side by side without a cross join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def scalar(df: DataFrame, value: Column) -> Column:
    """A whole-frame aggregate as a scalar subquery."""
    return df.agg(value).scalar()
