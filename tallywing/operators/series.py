"""Daily series: trend forecast, rolling anomalies, decomposition.

Every operator takes a frame with one row per day, or per (keys, day), so a window
partition is as long as the calendar and many series run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallywing.functions.numeric import rounded

Z95 = 1.96


def _series(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def forecast(daily: DataFrame, value: str, days: int = 14, keys: Sequence[str] = (),
             date: str = "date") -> DataFrame:
    """Quadratic least-squares trend with a ``days`` horizon.

    History rows carry the fit, future rows also a band of ±1.96 population deviations
    of the residuals with its lower edge cut at 0. The fit is the closed form from
    moments of t, t² and y, t centred for conditioning; fewer than three days give nulls.
    """
    s = _series(keys)
    y = F.col(value).cast("double")
    rows = daily.where(F.col(value).isNotNull()).select(*keys, F.col(date).alias("date"),
                                                        F.col(value), y.alias("_y"))
    rows = rows.withColumn("day_num", F.date_diff("date", F.min("date").over(s)))
    rows = rows.withColumn("_c", F.avg("day_num").over(s))
    u = F.col("day_num") - F.col("_c")
    rows = rows.withColumns({"_u": u, "_q": u * u})
    moments = {
        "_su": F.var_pop("_u"), "_sq": F.var_pop("_q"), "_suq": F.covar_pop("_u", "_q"),
        "_suy": F.covar_pop("_u", "_y"), "_sqy": F.covar_pop("_q", "_y"),
        "_mu": F.avg("_u"), "_mq": F.avg("_q"), "_my": F.avg("_y"), "_n": F.count("_y"),
    }
    rows = rows.withColumns({n: m.over(s) for n, m in moments.items()})
    su, sq, suq = F.col("_su"), F.col("_sq"), F.col("_suq")
    det = F.when(F.col("_n") >= 3, su * sq - suq * suq)
    rows = rows.withColumns({
        "_b1": F.try_divide(F.col("_suy") * sq - F.col("_sqy") * suq, det),
        "_b2": F.try_divide(F.col("_sqy") * su - F.col("_suy") * suq, det)})
    rows = rows.withColumn(
        "_b0", F.col("_my") - F.col("_b1") * F.col("_mu") - F.col("_b2") * F.col("_mq"))

    def curve(t: Column) -> Column:
        return F.col("_b0") + F.col("_b1") * t + F.col("_b2") * t * t

    fitted = rows.withColumn("predicted", curve(F.col("_u")))
    none = F.lit(None).cast("double")
    history = fitted.select(*keys, "date", value, "predicted", "day_num",
                            F.lit(False).alias("is_forecast"),
                            none.alias("lower_95"), none.alias("upper_95"))
    model = fitted.groupBy(*keys).agg(
        F.max("date").alias("_last"), F.max("day_num").alias("_end"), F.max("_c").alias("_c"),
        *[F.max(b).alias(b) for b in ("_b0", "_b1", "_b2")],
        F.stddev_pop(F.col("_y") - F.col("predicted")).alias("_sigma"))
    steps = model.select("*", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_step"))
    steps = steps.withColumn("day_num", F.col("_end") + F.col("_step")).where(
        F.col("_last").isNotNull())
    steps = steps.withColumn("predicted", curve(F.col("day_num") - F.col("_c")))
    future = steps.select(
        *keys, F.date_add("_last", F.col("_step")).alias("date"),
        F.lit(None).cast(daily.schema[value].dataType).alias(value), "predicted", "day_num",
        F.lit(True).alias("is_forecast"),
        F.when(F.col("predicted").isNotNull(), F.greatest(
            F.lit(0.0), F.col("predicted") - Z95 * F.col("_sigma"))).alias("lower_95"),
        (F.col("predicted") + Z95 * F.col("_sigma")).alias("upper_95"))
    return history.unionByName(future).orderBy(*keys, "date")


def rolling_anomalies(daily: DataFrame, value: str, keys: Sequence[str] = (), window: int = 7,
                      min_periods: int = 3, threshold: float = 2.5,
                      exclude_current: bool = False, date: str = "date") -> DataFrame:
    """z-score of each day against its trailing window, flagged beyond ``threshold``.

    With the tested day inside a window of n rows, |z| cannot exceed (n−1)/√n — 2.27
    for 7 — so the default never flags. ``exclude_current=True`` compares with the
    ``window`` rows before. A day without a z-score counts as a dip.
    """
    frame = _series(keys).orderBy(date).rowsBetween(
        -window if exclude_current else 1 - window, -1 if exclude_current else 0)
    y = F.col(value).cast("double")
    enough = F.count(value).over(frame) >= min_periods
    rows = daily.withColumns({
        "rolling_mean": F.when(enough, F.avg(y).over(frame)),
        "rolling_std": F.when(enough, F.stddev_samp(y).over(frame))})
    rows = rows.withColumn("z_score", (y - F.col("rolling_mean")) / (F.col("rolling_std") + 1e-9))
    return rows.withColumns({
        "is_anomaly": F.coalesce(F.abs("z_score") > threshold, F.lit(False)),
        "anomaly_direction": F.when(F.col("z_score") > 0, "Spike").otherwise("Dip"),
    }).orderBy(*keys, date)


def decompose(daily: DataFrame, value: str, keys: Sequence[str] = (),
              date: str = "date", outlier_z: float = 2.5) -> DataFrame:
    """Centred 7-row trend (at least 4 rows), weekday mean of the rest, residual and its z."""
    s = _series(keys)
    centred = s.orderBy("date").rowsBetween(-3, 3)
    rows = daily.select(*keys, F.col(date).alias("date"), F.col(value).cast("double").alias("actual"))
    rows = rows.withColumn("trend", F.when(
        F.count("actual").over(centred) >= 4, F.avg("actual").over(centred)))
    by_weekday = Window.partitionBy(*keys, F.weekday("date"))
    rows = rows.withColumn("seasonal", F.avg(F.col("actual") - F.col("trend")).over(by_weekday))
    rows = rows.withColumn("residual", F.col("actual") - F.col("trend") - F.col("seasonal"))
    z = F.try_divide(F.col("residual"), F.stddev_samp("residual").over(s))
    return rows.withColumn("residual_zscore", rounded(z, 3)).withColumn(
        "is_outlier", F.coalesce(F.abs("residual_zscore") > outlier_z, F.lit(False))
    ).orderBy(*keys, "date")


def decomposition_strength(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How much of the variation trend and weekday pattern explain, from ``decompose`` rows."""
    def strength(component: str) -> Column:
        var = F.var_samp("residual")
        return rounded(1 - var / F.greatest(F.var_samp(component) + var, F.lit(1e-9)), 4)

    return parts.groupBy(*keys).agg(strength("trend").alias("trend_strength"),
                                    strength("seasonal").alias("seasonal_strength"))
