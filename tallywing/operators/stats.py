"""Normalisers, distribution summaries and hypothesis tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numeric import mean, ratio, rounded
from tallywing.functions.special import f_pvalue
from tallywing.model import Warehouse
from tallywing.operators.common import with_employee
from tallywing.operators.ranking import average_ranks, quantiles
from tallywing.session import materialize


def sized(groups: DataFrame) -> DataFrame:
    """Store one-row-per-group results that row-level data will be joined to.

    The size of a stored table is known when the join is planned: below Spark's
    broadcast threshold the rows stay where they are, however unevenly the groups are
    filled; above it the join is shuffled as usual.
    """
    return materialize(groups, "groups")


def with_groups(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the columns of its group, the group of null keys included."""
    named = side.withColumnsRenamed({k: f"_key{n}" for n, k in enumerate(keys)})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)])
    return df.join(named, same).drop(*[f"_key{n}" for n in range(len(keys))])


def _with_aggregates(df: DataFrame, aggregates: dict[str, Column],
                     keys: Sequence[str]) -> DataFrame:
    """Append group aggregates: scalar subqueries for the whole frame, a join per key."""
    if not keys:
        whole = df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()])).scalar()
        return df.withColumn("_whole", whole).select(
            *df.columns, *[F.col(f"_whole.{n}") for n in aggregates])
    side = sized(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()]))
    return with_groups(df, side, keys)


def minmax_normalize(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_n`` scaled to [0, 1]; 0.5 where the column is constant."""
    aggs: dict[str, Column] = {}
    for c in columns:
        aggs |= {f"_lo_{c}": F.min(c).cast("double"), f"_hi_{c}": F.max(c).cast("double")}
    wide = _with_aggregates(df, aggs, keys)
    span = {c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}") for c in columns}
    return wide.withColumns({
        f"{c}_n": F.when(span[c] > 0, (F.col(c).cast("double") - F.col(f"_lo_{c}")) / span[c])
        .otherwise(F.lit(0.5)) for c in columns}).drop(*aggs)


def max_normalize(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_n``, the column over its maximum; 0 where the maximum is not positive."""
    wide = _with_aggregates(df, {f"_max_{c}": F.max(c) for c in columns}, keys)
    return wide.withColumns({
        f"{c}_n": F.when(F.col(f"_max_{c}") > 0, ratio(F.col(c), F.col(f"_max_{c}")))
        .otherwise(F.lit(0.0)) for c in columns}).drop(*[f"_max_{c}" for c in columns])


def standardize(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``<c>_z`` with population deviation; 0 where the column is constant."""
    aggs: dict[str, Column] = {}
    for c in columns:
        aggs |= {f"_mean_{c}": mean(F.col(c)), f"_dev_{c}": F.stddev_pop(F.col(c).cast("double"))}
    wide = _with_aggregates(df, aggs, keys)
    return wide.withColumns({
        f"{c}_z": F.when(F.col(f"_dev_{c}") > 0,
                         (F.col(c).cast("double") - F.col(f"_mean_{c}")) / F.col(f"_dev_{c}"))
        .otherwise(F.lit(0.0)) for c in columns}).drop(*aggs)


def histogram(df: DataFrame, column: str, nbins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``nbins`` equal-width bins of the column's overall range.

    Bins are numbered from 1; the maximum belongs to the last one. Empty bins are
    not listed. Bin edges are shared by all groups of ``by``.
    """
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull()).select(*by, v.alias("_v"))
    ends = rows.agg(F.struct(F.min("_v").alias("low"), F.max("_v").alias("high"))).scalar()
    placed = rows.withColumn("_ends", ends).select(
        *by, "_v", F.col("_ends.low").alias("_low"),
        ((F.col("_ends.high") - F.col("_ends.low")) / nbins).alias("_step"))
    number = F.when(F.col("_step") > 0, F.least(
        F.lit(nbins), F.floor((F.col("_v") - F.col("_low")) / F.col("_step")) + 1)).otherwise(1)
    counted = placed.groupBy(*by, number.cast("int").alias("bin"), "_low", "_step").agg(
        F.count(F.lit(1)).alias("count"))
    return counted.select(
        *by, "bin",
        (F.col("_low") + (F.col("bin") - 1) * F.col("_step")).alias("bin_start"),
        (F.col("_low") + F.col("bin") * F.col("_step")).alias("bin_end"),
        "count").orderBy(*by, "bin")


def box_stats(df: DataFrame, column: str, by: Sequence[str],
              digits: int = 4) -> DataFrame:
    """Five-number summary, 1.5·IQR fences and the number of rows beyond them.

    Counts per value are stored, because the fences and the rows beyond them are found in
    two jobs that would each run ``df``.
    """
    counts = materialize(df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(
        F.count(F.lit(1)).alias("_n")), "values")
    quarters = quantiles(counts, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by,
                         weight="_n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fenced = quarters.withColumns({"lower_fence": F.col("q1") - reach,
                                   "upper_fence": F.col("q3") + reach})
    v = F.col(column).cast("double")
    beyond = (v < F.col("lower_fence")) | (v > F.col("upper_fence"))
    parts = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    rows = with_groups(counts, sized(fenced), by).groupBy(*by).agg(
        F.sum("_n").alias("n"),
        rounded(F.min(v), digits).alias("min"),
        *[rounded(F.max(p), digits).alias(p) for p in parts],
        rounded(F.max(v), digits).alias("max"),
        F.sum(F.when(beyond, F.col("_n")).otherwise(0)).alias("outliers"))
    return rows.orderBy(*by)


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F statistic and degrees of freedom as one row; null F for one group.

    Only n, mean and variance per group leave the tasks.
    """
    v = F.col(value).cast("double")
    groups = df.where(v.isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), mean(F.col(value)).alias("m"), F.var_pop(v).alias("var"))
    sums = groups.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.sum(F.col("n") * F.col("m")).alias("nm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"))
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return sums.select(
        F.when((df1 > 0) & (df2 > 0), F.try_divide(
            between / F.nullif(df1, F.lit(0)), F.col("within") / F.nullif(df2, F.lit(0)))
        ).alias("f"), df1.alias("df_between"), df2.alias("df_within"))


def _test_row(stat: DataFrame) -> DataFrame:
    p = f_pvalue(F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double"))
    return stat.withColumn("_p", p).withColumns({
        "p_value": rounded(F.col("_p"), 6), "significant": F.col("_p") < 0.05})


def _session_costs(wh: Warehouse, *columns: str) -> DataFrame:
    """Paid sessions with directory columns."""
    paid = wh.sessions.where(F.col("total_cost_usd") > 0).select("user_email", "total_cost_usd")
    return with_employee(paid, wh, *columns)


def cost_anova_by_practice(wh: Warehouse) -> DataFrame:
    """Does the mean session cost differ between practices?"""
    stat = anova(_session_costs(wh, "practice"), "practice", "total_cost_usd").withColumns(
        {"df1": F.col("df_between"), "df2": F.col("df_within")})
    return _test_row(stat).select(
        rounded(F.col("f"), 4).alias("f_statistic"), "df_between", "df_within",
        "p_value", "significant")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks as one row ``(rho, n)``.

    Rows are folded to counts per (x, y); ranks come from bucketed cumulation and the
    correlation from sums of centred ranks, so ties of any size cost one row.
    """
    xv, yv = F.col(x).cast("double"), F.col(y).cast("double")
    pairs = materialize(df.where(xv.isNotNull() & yv.isNotNull()).groupBy(
        xv.alias("_x"), yv.alias("_y")).agg(F.count(F.lit(1)).alias("w")), "pairs")

    def centred(column: str) -> DataFrame:
        folded = pairs.groupBy(column).agg(F.sum("w").alias("w"))
        ranks = average_ranks(folded, column, weight="w")
        return ranks.select(F.col("value").alias(column),
                            (F.col("rank") - (F.col("total") + 1) / 2).alias(f"d{column}"))

    both = pairs.join(sized(centred("_x")), "_x").join(centred("_y"), "_y")
    dx, dy, w = F.col("d_x"), F.col("d_y"), F.col("w").cast("double")
    return both.agg(
        F.when(F.sum("w") >= 3, F.try_divide(
            F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy)))).alias("rho"),
        F.sum("w").alias("n"))


def level_cost_correlation(wh: Warehouse) -> DataFrame:
    """Rank correlation of seniority and session cost."""
    rank = spearman(_session_costs(wh, "level_num"), "level_num", "total_cost_usd")
    r2 = F.col("rho") * F.col("rho")
    stat = rank.withColumns({
        "f": F.coalesce(F.try_divide(r2 * (F.col("n") - 2), 1 - r2), F.lit(float("inf"))),
        "df1": F.when(F.col("rho").isNotNull(), 1), "df2": F.col("n") - 2})
    return _test_row(stat).select(
        rounded(F.col("rho"), 4).alias("spearman_rho"), "p_value", "significant",
        F.when(F.col("rho") > 0, "positive").otherwise("negative").alias("direction"), "n")


def session_duration_stats(wh: Warehouse, max_minutes: float = 480) -> DataFrame:
    """Moments and quantiles of session length per practice (population skew, kurtosis)."""
    d = F.col("duration_min")
    timed = wh.sessions.where((d > 0) & (d < max_minutes)).groupBy("user_email", "duration_min").agg(
        F.count(F.lit(1)).alias("w"))
    counts = with_employee(timed, wh, "practice").groupBy("practice", "duration_min").agg(
        F.sum("w").alias("w"))
    points = quantiles(counts, "duration_min", {"median": 0.5, "p10": 0.1, "p90": 0.9},
                       ["practice"], weight="w")
    # Durations are multiples of 0.01 below the cut, so counts per value are a short table
    # and the moments can be taken about the exact mean.
    centre = counts.groupBy("practice").agg(
        F.sum("w").alias("n"), ratio(F.sum(d * F.col("w")), F.sum("w")).alias("m"))
    gap = d - F.col("m")
    moments = counts.join(centre, "practice").groupBy("practice", "n", "m").agg(
        F.sum(F.col("w") * gap * gap).alias("s2"),
        F.sum(F.col("w") * gap * gap * gap).alias("s3"),
        F.sum(F.col("w") * gap * gap * gap * gap).alias("s4"))
    n, var = F.col("n"), F.col("s2") / F.col("n")
    return (moments.join(points, "practice").select(
        "practice", "n",
        rounded(F.col("m"), 2).alias("mean"),
        rounded(F.col("median"), 2).alias("median"),
        rounded(F.sqrt(F.try_divide(F.col("s2"), n - 1)), 2).alias("std"),
        rounded(F.col("p10"), 2).alias("p10"),
        rounded(F.col("p90"), 2).alias("p90"),
        rounded(F.try_divide(F.col("s3") / n, F.pow(var, F.lit(1.5))), 3).alias("skewness"),
        rounded(F.try_divide(F.col("s4") / n, var * var) - 3, 3).alias("kurtosis"),
    ).orderBy(F.desc("mean"), "practice"))
