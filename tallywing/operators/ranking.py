"""Exact ranks and quantiles that never put a whole group into one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, and a
``rank`` window sorts a group in one task. Here the rows of a group are first
collapsed to counts per distinct value, and the values are cut into buckets at
approximate quantiles, so that each holds about the same number of distinct ones whatever
the distribution: only the short list of bucket totals is cumulated per group, while
values are cumulated inside their own bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128


def cumulative_counts(df: DataFrame, value: str, keys: Sequence[str] = (),
                      weight: str | None = None, buckets: int = BUCKETS,
                      keep_bucket: bool = False) -> DataFrame:
    """Per (keys, distinct value): ``n`` rows, ``below`` smaller ones, ``total`` of the group.

    Any number of ``buckets`` gives the same answer; a task holds about one part in
    ``buckets`` of the values. ``weight`` names a column of row multiplicities; values whose
    multiplicities sum to zero or less are left out.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(*keys, v.alias("value"), *([weight] if weight else []))
    n = F.sum(weight) if weight else F.count(F.lit(1))
    # Three steps read this. The condition makes all of them ask for the same columns, so
    # that Spark runs ``df`` and its shuffle once and reuses the exchange.
    folded = rows.groupBy(*keys, "value").agg(n.alias("n")).where("n > 0")
    shares = [k / buckets for k in range(1, buckets)] or [0.5]
    cuts = folded.agg(F.array_distinct(F.percentile_approx("value", shares, 10 * buckets))).scalar()
    counts = folded.withColumn("_cuts", cuts).select(
        *keys, "value", "n",
        F.size(F.filter("_cuts", lambda c: c < F.col("value"))).alias("_bucket"))

    inside = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    values = counts.withColumn("_upto", F.sum("n").over(inside))

    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    held = counts.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_in"))
    held = held.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        (F.sum("_in").over(group.orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)) - F.col("_in")).alias("_before"),
        F.sum("_in").over(group).alias("total"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = F.col("_bucket") == F.col("_b")
    for cond in same:
        on = on & cond
    return values.join(held, on).select(
        *keys, "value", "n",
        (F.col("_before") + F.col("_upto") - F.col("n")).alias("below"), "total",
        *(["_bucket"] if keep_bucket else []))


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float],
              keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles, one column per entry of ``probs``."""
    counted = cumulative_counts(df, value, keys, weight)

    def at(rank: Column) -> Column:
        hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    picks = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("total") - 1)
        picks += [at(F.floor(position)).alias(f"_lo_{name}"),
                  at(F.ceil(position)).alias(f"_hi_{name}"),
                  F.max(position - F.floor(position)).alias(f"_part_{name}")]
    picked = counted.groupBy(*keys).agg(*picks)
    return picked.select(*keys, *[
        (F.col(f"_lo_{name}")
         + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_part_{name}")).alias(name)
        for name in probs])


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (),
                  weight: str | None = None) -> DataFrame:
    """Per distinct value its 1-based rank, ties sharing the average."""
    counted = cumulative_counts(df, value, keys, weight)
    return counted.select(*keys, "value", "n", "total",
                          (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))
