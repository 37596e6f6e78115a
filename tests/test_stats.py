import math
import random

import numpy as np
import pytest
from builders import at, make, rows, sessions
from pyspark.sql import functions as F

from tallywing.functions.special import f_tail, incomplete_beta
from tallywing.operators import stats


@pytest.mark.parametrize("f, df1, df2, p", [
    # Published 5 % and 1 % points of F, and of t² for one numerator degree.
    (4.96, 1, 10, 0.05), (3.49, 3, 12, 0.05), (2.45, 4, 120, 0.05), (10.04, 1, 10, 0.01),
    (5.95, 3, 12, 0.01), (2.228 ** 2, 1, 10, 0.05)])
def test_f_tail_equals_tables(f, df1, df2, p):
    assert f_tail(f, df1, df2) == pytest.approx(p, rel=0.01)


def test_f_tail_edges():
    assert f_tail(0.0, 2, 5) == 1.0
    assert f_tail(math.inf, 2, 5) == 0.0
    assert f_tail(None, 2, 5) is None and f_tail(1.0, 0, 5) is None
    assert incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert f_tail(1.0, 7, 7) == pytest.approx(0.5)


def frame(spark, pairs, schema="g string, v double"):
    return spark.createDataFrame(pairs, schema)


def test_anova_equals_hand_calculation(spark):
    groups = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = frame(spark, [(g, float(v)) for g, vs in groups.items() for v in vs])
    (row,) = rows(stats.anova(df, "g", "v"))
    assert row["f"] == pytest.approx(9.264705882) and row["df_within"] == 15
    (none,) = rows(stats.anova(df.where("g = 'a'"), "g", "v"))
    assert none["f"] is None


def test_anova_report(spark):
    wh = make(spark, employees=[{"email": "a"}, {"email": "b", "practice": "Web"}],
              sessions=sessions(spark, [
                  {"user_email": u, "start_time": at("2024-01-01"), "total_cost_usd": c}
                  for u, c in [("a", 1.0), ("a", 1.1), ("a", 0.9), ("b", 9.0), ("b", 9.2), ("b", 0.0)]]))
    (row,) = rows(stats.cost_anova_by_practice(wh))
    assert row["significant"] is True and row["p_value"] < 0.001 and row["df_within"] == 3
    (alone,) = rows(stats.cost_anova_by_practice(make(spark)))
    assert alone["f_statistic"] is None and alone["p_value"] is None


def _ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_spearman_equals_ranked_correlation(spark):
    rng = random.Random(2)
    x = [rng.randrange(5) for _ in range(200)]
    y = [a + rng.randrange(7) for a in x]
    (row,) = rows(stats.spearman(frame(spark, list(zip(map(float, x), map(float, y))),
                                       "x double, y double"), "x", "y"))
    assert row["rho"] == pytest.approx(np.corrcoef(_ranks(x), _ranks(y))[0, 1])
    assert row["n"] == 200


def test_spearman_needs_three_rows_and_variation(spark):
    two = frame(spark, [(1.0, 2.0), (2.0, 3.0)], "x double, y double")
    assert rows(stats.spearman(two, "x", "y"))[0]["rho"] is None
    flat = frame(spark, [(1.0, float(n)) for n in range(5)], "x double, y double")
    assert rows(stats.spearman(flat, "x", "y"))[0]["rho"] is None


def test_level_correlation_direction(spark):
    people = [{"email": f"u{n}", "level_num": n} for n in range(1, 9)]
    costs = [{"user_email": f"u{n}", "start_time": at("2024-01-01"), "total_cost_usd": 10.0 - n}
             for n in range(1, 9)]
    (row,) = rows(stats.level_cost_correlation(make(spark, employees=people,
                                                    sessions=sessions(spark, costs))))
    assert row["spearman_rho"] == -1.0 and row["direction"] == "negative"
    assert row["p_value"] == 0.0 and row["significant"] is True


def test_normalisers(spark):
    df = frame(spark, [("a", 1.0), ("a", 3.0), ("b", 5.0)])
    assert sorted(r["v_n"] for r in rows(stats.minmax_normalize(df, ["v"]))) == [0.0, 0.5, 1.0]
    keyed = {(r["g"], r["v"]): r["v_n"] for r in rows(stats.minmax_normalize(df, ["v"], ["g"]))}
    assert keyed == {("a", 1.0): 0.0, ("a", 3.0): 1.0, ("b", 5.0): 0.5}
    zero = frame(spark, [("a", 0.0)])
    assert rows(stats.max_normalize(zero, ["v"]))[0]["v_n"] == 0.0
    assert rows(stats.standardize(zero, ["v"]))[0]["v_z"] == 0.0


def test_histogram_holds_the_maximum_and_all_rows(spark):
    df = frame(spark, [("a", float(n)) for n in range(11)])
    got = rows(stats.histogram(df, "v", 5))
    assert [r["count"] for r in got] == [2, 2, 2, 2, 3] and got[-1]["bin_end"] == 10.0
    (one,) = rows(stats.histogram(frame(spark, [("a", 4.0), ("b", 4.0)]), "v", 5))
    assert (one["bin"], one["count"]) == (1, 2)


def test_box(spark):
    df = frame(spark, [("a", float(v)) for v in (1, 2, 3, 4, 100)])
    (row,) = rows(stats.box_stats(df, "v", ["g"]))
    assert (row["q1"], row["median"], row["q3"], row["outliers"], row["n"]) == (2, 3, 4, 1, 5)


def test_duration_moments(spark):
    minutes = [1.0, 2.0, 2.5, 10.0, 30.25]
    wh = make(spark, employees=[{"email": "a"}], sessions=sessions(spark, [
        {"user_email": "a", "start_time": at("2024-01-01"), "duration_min": m}
        for m in [*minutes, 0.0, 480.0, None]]))
    (row,) = rows(stats.session_duration_stats(wh))
    d = np.array(minutes)
    z = (d - d.mean()) / d.std()
    assert row["n"] == 5 and row["skewness"] == pytest.approx((z ** 3).mean(), abs=6e-4)
    assert row["kurtosis"] == pytest.approx((z ** 4).mean() - 3, abs=6e-4)
    assert row["std"] == pytest.approx(d.std(ddof=1), abs=6e-3)


def test_groups_of_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 4.0)], "k string, v double")
    assert sorted(r["v_z"] for r in stats.standardize(df, ["v"], ["k"]).collect()) == [-1, -1, 1, 1]
    assert sorted(r["v_n"] for r in stats.minmax_normalize(df, ["v"], ["k"]).collect()) == [0, 0, 1, 1]
    assert sorted(r["v_n"] for r in stats.max_normalize(df, ["v"], ["k"]).collect())[-2:] == [1, 1]
    assert {r["k"]: r["n"] for r in stats.box_stats(df, "v", ["k"]).collect()} == {"a": 2, None: 2}


def test_box_stats_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    df = spark.range(40).select(F.lit("a").alias("g"), F.udf(count, "double")(F.col("id").cast("double")).alias("v"))
    row = stats.box_stats(df.where("v >= 0"), "v", ["g"]).first()
    assert (row["n"], row["median"], row["outliers"]) == (40, 19.5, 0)
    assert seen.value <= 80  # the filter may run the function once more
