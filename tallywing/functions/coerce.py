"""Lenient conversion of string attributes, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's cast also takes type suffixes ('12d', '12f') and hexadecimal, which are no numbers
# here; and it rejects digit groups ('1_000'), which are.
_FOREIGN = r"[xX]|[dDfF]\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf\s*$"
_GROUPED = r"^\s*[+-]?\d+(_\d+)*(\.\d+(_\d+)*)?([eE][+-]?\d+(_\d+)*)?\s*$"


def _number(value: Column) -> Column:
    grouped = F.replace(value, F.lit("_"), F.lit("")).try_cast("double")
    return (F.when(F.contains(value, F.lit("_")), F.when(value.rlike(_GROUPED), grouped))
            .when(~value.rlike(_FOREIGN) | value.rlike(_INFINITE), value.try_cast("double")))


def as_float(value: Column, default: float = 0.0) -> Column:
    """A double, ``default`` where the text is no number, null for NaN."""
    number = F.coalesce(_number(value), F.lit(default))
    return F.when(~F.isnan(number), number)


def as_whole(value: Column) -> Column:
    """A bigint truncated toward zero; null for text, NaN and infinities."""
    return _number(value).try_cast("bigint")


def as_int(value: Column, default: int = 0) -> Column:
    """Like :func:`as_whole` with ``default`` in place of null."""
    return F.coalesce(as_whole(value), F.lit(default).cast("bigint"))


def as_flag(value: Column) -> Column:
    """1 for 'true' in any case, otherwise 0."""
    return F.when(F.lower(value) == "true", 1).otherwise(0)
