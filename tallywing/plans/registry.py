"""The catalogue: named queries with the DuckDB SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallywing.plans import fixtures


@dataclass
class Inputs:
    """What a query may read: the given parquet files and the warehouse derived from them."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def wh(self) -> fixtures.DerivedWarehouse:
        return fixtures.DerivedWarehouse(self.spark, self.sf_dir)

    def parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    sql: str | None = None


class Catalogue(dict[str, Query]):
    def add(self, name: str, run: Callable[[Inputs], DataFrame], sql: str | None = None,
            plain: str | None = None) -> None:
        """``sql`` reads the derived tables, ``plain`` the given ones."""
        if name in self:
            raise ValueError(f"query {name!r} is registered twice")
        self[name] = Query(run, fixtures.oracle(sql) if sql else plain)


# Text helpers for the oracles.

def R(value: str, digits: int) -> str:
    """Half-up rounding of the digits a double prints."""
    return (f"CAST(round(CAST(CAST(CAST({value} AS double) AS varchar) AS decimal(38,14)), {digits})"
            " AS double)")


def M(value: str) -> str:
    """Average as double."""
    return f"(CAST(sum({value}) AS double) / nullif(count({value}), 0))"


def P(part: str, whole: str, digits: int = 1) -> str:
    """Percentage."""
    return R(f"100 * (CAST({part} AS double) / nullif(CAST({whole} AS double), 0))", digits)


def S(value: str) -> str:
    """Sum of integers as bigint."""
    return f"CAST(sum({value}) AS bigint)"


WEEK = "strftime({}, '%Y-W%W')".format
EMP = "JOIN employees e ON e.email = {}.user_email".format
