"""Sketches of days merged into periods."""

import random

import pytest
from builders import at, make, rows
from pyspark.sql import functions as F

from tallywing.operators import sketches


@pytest.fixture(scope="module")
def busy(spark):
    rng = random.Random(7)
    requests = [{"session_id": f"s{k}", "user_email": f"u{rng.randrange(900)}@x" if k % 50 else None,
                 "timestamp": at(f"2024-01-{1 + k % 20:02d} 10:00:00"), "input_tokens": rng.randrange(10_000), "total_tokens": 1 + k % 3,
                 "cost_usd": rng.choice([None, float("nan"), 1.0, rng.random()])} for k in range(6_000)]
    requests += [{"session_id": "idle", "total_tokens": 0, "timestamp": at("2024-01-05 10:00:00")}]
    return make(spark, api_requests=requests)


def test_users_of_any_range_of_days(busy):
    days = sketches.day_users(busy)
    for first, last in ((1, 1), (3, 9), (1, 20)):
        part = F.dayofmonth("date").between(first, last)
        (near,) = rows(sketches.merged_users(days.where(part)))
        exact = busy.sessions.where(F.dayofmonth("start_time").between(first, last)).agg(
            F.countDistinct("user_email").alias("users"), F.count(F.lit(1)).alias("sessions")).first()
        assert near["sessions"] == exact.sessions
        assert abs(near["active_users_approx"] - exact.users) <= max(1, sketches.USER_ERROR * exact.users)


def test_merging_weeks_first_changes_nothing_exact(busy):
    days = sketches.day_users(busy)
    weeks = sketches.merged_users(days, F.weekofyear("date").alias("date"))
    (whole,), (stepped,) = rows(sketches.merged_users(days)), rows(sketches.merged_users(weeks))
    assert whole["sessions"] == stepped["sessions"]
    assert whole["active_users_approx"] == pytest.approx(stepped["active_users_approx"], rel=0.01)


def test_quantiles_of_merged_days(busy):
    days = sketches.day_values(busy)
    near = sketches.merged_values(days)
    metrics = busy.api_requests.where("total_tokens > 0").select(
        *[F.col(m).cast("double").alias(m) for m in ("input_tokens", "cost_usd")])
    long = metrics.unpivot([], ["input_tokens", "cost_usd"], "metric", "value").where("value is not null and not isnan(value)")
    exact = {r["metric"]: r for r in rows(long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))}
    got = {r["metric"]: r for r in rows(near)}
    for metric, want in exact.items():
        assert got[metric]["n"] == want["n"] and got[metric]["mean"] == pytest.approx(want["mean"])
    for r in rows(sketches.rank_errors(near, long, ["metric"])):
        assert all(r[p] <= sketches.RANK_ERROR for p in sketches.TOKEN_PROBS)


def test_rank_error_counts_ties_as_a_range(spark):
    values = spark.createDataFrame([("m", float(v)) for v in [1, 2, 2, 2, 3, 4, 5, 6, 7, 8]], "metric string, value double")
    told = spark.createDataFrame([("m", 2.0, 9.0)], "metric string, p25 double, p50 double")
    (r,) = rows(sketches.rank_errors(told, values, ["metric"], {"p25": 0.25, "p50": 0.5}))
    assert r["p25"] == 0.0 and r["p50"] == pytest.approx(0.5) and r["n"] == 10


def test_no_rows(spark):
    wh = make(spark)
    assert rows(sketches.day_values(wh)) == [] and rows(sketches.merged_users(sketches.day_users(wh), F.col("date"))) == []
