"""Overview, cost and token analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywing.functions.numeric import mean, pct, ratio, rounded
from tallywing.functions.timeparts import week_label, weekday_sunday0
from tallywing.model import Warehouse
from tallywing.operators.common import one_row, with_employee
from tallywing.operators.ranking import quantiles
from tallywing.operators.stats import minmax_normalize, sized

LONG_SESSION_MIN = 480


def kpi_summary(wh: Warehouse, approx: bool = False) -> DataFrame:
    """One row of headline figures. ``approx`` estimates the distinct user count."""
    users = F.approx_count_distinct("user_email") if approx else F.countDistinct("user_email")
    short = F.when(F.col("duration_min") < LONG_SESSION_MIN, F.col("duration_min"))
    sessions = wh.sessions.agg(
        users.alias("total_users"),
        F.count(F.lit(1)).alias("total_sessions"),
        rounded(mean(F.col("num_api_calls")), 1).alias("avg_api_per_session"),
        rounded(mean(short), 1).alias("avg_session_min"),
    )
    requests = wh.api_requests.agg(
        F.count(F.lit(1)).alias("total_api_calls"),
        rounded(F.sum("cost_usd"), 2).alias("total_cost_usd"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    errors = wh.api_errors.agg(F.count(F.lit(1)).alias("total_errors"))
    row = one_row(sessions, requests, errors)
    return row.withColumn("error_rate_pct", pct(
        F.col("total_errors"), F.greatest("total_api_calls", F.lit(1)), 2))


def daily_activity(wh: Warehouse) -> DataFrame:
    return (wh.sessions.groupBy(F.to_date("start_time").alias("date")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("num_api_calls").alias("api_calls"),
        rounded(F.sum("total_cost_usd"), 4).alias("cost_usd"),
        F.sum("total_tokens").alias("tokens"),
        F.countDistinct("user_email").alias("active_users"),
    ).orderBy("date"))


def hourly_heatmap(wh: Warehouse) -> DataFrame:
    return (wh.sessions.groupBy(
        weekday_sunday0(F.col("start_time")).alias("dow"),
        F.hour("start_time").alias("hour"))
        .agg(F.count(F.lit(1)).alias("sessions")).orderBy("dow", "hour"))


def heatmap_pivot(wh: Warehouse) -> DataFrame:
    """The heatmap as 7 rows × 24 columns ``h0``..``h23``, zero where nothing started."""
    spark = wh.sessions.sparkSession
    spine = spark.range(7).select(F.col("id").cast("int").alias("dow"),
                                  F.lit(None).cast("int").alias("hour"),
                                  F.lit(0).cast("bigint").alias("sessions"))
    cells = hourly_heatmap(wh).unionByName(spine)
    wide = cells.groupBy("dow").pivot("hour", list(range(24))).agg(F.sum("sessions"))
    return wide.select("dow", *[
        F.coalesce(F.col(f"`{h}`"), F.lit(0)).cast("bigint").alias(f"h{h}") for h in range(24)
    ]).orderBy("dow")


def weekly_trend(wh: Warehouse) -> DataFrame:
    return (wh.sessions.groupBy(week_label(F.col("start_time")).alias("week")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.countDistinct("user_email").alias("active_users"),
        rounded(F.sum("total_cost_usd"), 2).alias("cost_usd"),
        rounded(mean(F.col("total_cost_usd")), 4).alias("avg_cost_per_session"),
    ).orderBy("week"))


def weekly_cost_mean(wh: Warehouse) -> DataFrame:
    """Mean over weeks of the weekly average cost per session."""
    return weekly_trend(wh).agg(
        F.count(F.lit(1)).alias("weeks"),
        rounded(mean(F.col("avg_cost_per_session")), 6).alias("period_avg_cost"))


def cost_by_model(wh: Warehouse) -> DataFrame:
    return (wh.api_requests.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        rounded(F.sum("cost_usd"), 2).alias("total_cost"),
        rounded(mean(F.col("cost_usd")), 4).alias("avg_cost"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read"),
        F.sum("cache_creation_tokens").alias("cache_creation"),
        rounded(mean(F.col("duration_ms")) / 1000, 2).alias("avg_duration_s"),
    ).orderBy(F.desc("total_cost"), "model"))


def _requests_per_user(wh: Warehouse) -> DataFrame:
    """Requests folded per user: later joins and distinct counts see one row per user."""
    return wh.api_requests.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count("cost_usd").alias("priced"),
        F.sum("cost_usd").alias("cost"),
        F.sum("total_tokens").alias("tokens"),
    )


def cost_by_practice(wh: Warehouse) -> DataFrame:
    users = with_employee(_requests_per_user(wh), wh, "practice")
    return (users.groupBy("practice").agg(
        F.count(F.lit(1)).alias("engineers"),
        F.sum("calls").alias("api_calls"),
        rounded(F.sum("cost"), 2).alias("total_cost"),
        rounded(ratio(F.sum("cost"), F.sum("priced")), 4).alias("avg_cost_per_call"),
        F.sum("tokens").alias("total_tokens"),
    ).orderBy(F.desc("total_cost"), "practice"))


def cost_by_level(wh: Warehouse) -> DataFrame:
    users = with_employee(_requests_per_user(wh), wh, "level", "level_num", "practice")
    return (users.groupBy("level", "level_num", "practice").agg(
        F.count(F.lit(1)).alias("engineers"),
        F.sum("calls").alias("api_calls"),
        rounded(F.sum("cost"), 2).alias("total_cost"),
        rounded(ratio(F.sum("cost"), F.count(F.lit(1))), 2).alias("cost_per_engineer"),
    ).orderBy("level_num", "level", "practice"))


TOKEN_METRICS = ["input_tokens", "output_tokens", "total_tokens", "cost_usd"]
TOKEN_PROBS = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}


def token_distribution(wh: Warehouse, approx: bool = False) -> DataFrame:
    """Quantiles, mean and sample deviation of four request measures.

    ``approx`` swaps the exact quantiles for ``percentile_approx`` (one pass).
    """
    rows = wh.api_requests.where(F.col("total_tokens") > 0)
    long = rows.select(*[F.col(m).cast("double").alias(m) for m in TOKEN_METRICS]).unpivot(
        [], TOKEN_METRICS, "metric", "value")
    spread = long.groupBy("metric").agg(
        rounded(mean(F.col("value")), 2).alias("mean"),
        rounded(F.stddev_samp("value"), 2).alias("std"))
    if approx:
        points = long.groupBy("metric").agg(*[
            F.percentile_approx("value", p).alias(name) for name, p in TOKEN_PROBS.items()])
    else:
        points = quantiles(long, "value", TOKEN_PROBS, ["metric"])
    points = points.select("metric", *[rounded(F.col(p), 2).alias(p) for p in TOKEN_PROBS])
    return points.join(spread, "metric")


def cache_efficiency(wh: Warehouse) -> DataFrame:
    reads, fresh = F.sum("cache_read_tokens"), F.sum("input_tokens")
    return (wh.api_requests.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        reads.alias("cache_hits"),
        F.sum("cache_creation_tokens").alias("cache_writes"),
        fresh.alias("fresh_tokens"),
        pct(reads, reads + fresh).alias("cache_hit_rate_pct"),
    ).orderBy(F.desc("cache_hit_rate_pct"), "model"))


def model_usage_trend(wh: Warehouse) -> DataFrame:
    """Calls per week and model with the share of the week's calls."""
    calls = wh.api_requests.groupBy(week_label(F.col("timestamp")).alias("week"), "model").agg(
        F.count(F.lit(1)).alias("calls"))
    week = Window.partitionBy("week")
    return calls.withColumn("share_pct", pct(
        F.col("calls"), F.sum("calls").over(week), 2)).orderBy("week", "model")


def model_efficiency_index(wh: Warehouse) -> DataFrame:
    """Weighted score per model of output yield, cache leverage, cost and speed."""
    reads = F.sum("cache_read_tokens")
    models = wh.api_requests.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        rounded(mean(F.col("cost_usd")), 6).alias("avg_cost"),
        rounded(mean(F.col("output_tokens")), 2).alias("avg_output"),
        rounded(mean(F.col("duration_ms")) / 1000, 3).alias("avg_duration_s"),
        ratio(F.sum("output_tokens"), F.sum("total_tokens")).alias("output_yield"),
        ratio(reads, reads + F.sum("input_tokens")).alias("cache_leverage"),
    ).withColumn("cost_per_output", ratio(F.col("avg_cost"), F.col("avg_output")))
    # One row per model, stored: the ranges read it a second time.
    inputs = sized(models).select(
        "*",
        F.coalesce("output_yield", F.lit(0.0)).alias("_yield"),
        F.coalesce("cache_leverage", F.lit(0.0)).alias("_cache"),
        F.coalesce("cost_per_output", F.lit(0.0)).alias("_cost"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("avg_duration_s")), F.lit(1.0)).alias("_speed"),
    )
    scaled = minmax_normalize(inputs, ["_yield", "_cache", "_cost", "_speed"])
    score = (0.30 * F.col("_yield_n") + 0.30 * F.col("_cache_n")
             + 0.25 * (1 - F.col("_cost_n")) + 0.15 * F.col("_speed_n"))
    return (scaled.withColumn("efficiency_score", rounded(100 * rounded(score, 4), 2))
            .select("model", "calls", "avg_cost", "avg_output", "avg_duration_s", "output_yield",
                    "cache_leverage", "cost_per_output", "efficiency_score")
            .orderBy(F.desc("efficiency_score"), "model"))
