import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallywing.operators.ranking import average_ranks, cumulative_counts, quantiles

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def frame(spark, values):
    return spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-500, 500).map(lambda n: n / 4), min_size=1, max_size=60),
       extreme=st.sampled_from([[], [1e12], [-1e9, 1e15]]))
def test_quantiles_equal_numpy(spark, values, extreme):
    values = values + extreme
    row = quantiles(frame(spark, values), "v", PROBS).first()
    for name, p in PROBS.items():
        assert math.isclose(row[name], np.quantile(values, p), rel_tol=1e-12, abs_tol=1e-12)


def test_one_key_with_most_rows(spark):
    rng = random.Random(3)
    groups = {"hot": [rng.choice([1.0, 2.5, 9.0]) for _ in range(4000)] + [rng.random() * 50
              for _ in range(1000)], "small": [5.0], "pair": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in quantiles(df, "v", PROBS, ["g"]).collect()}
    for g, vs in groups.items():
        for name, p in PROBS.items():
            assert math.isclose(got[g][name], np.quantile(vs, p), rel_tol=1e-12)


def test_null_key_and_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 4.0)],
                               "g string, v double")
    got = {r["g"]: r["m"] for r in quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {None: 2.0, "a": 4.0}


def test_weights_count_as_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (10.0, 1)], "v double, w bigint")
    row = quantiles(df, "v", {"m": 0.5, "hi": 1.0}, weight="w").first()
    assert (row["m"], row["hi"]) == (1.0, 10.0)


@pytest.mark.parametrize("buckets", [1, 2, 100])
def test_cumulative_counts(spark, buckets):
    rows = cumulative_counts(frame(spark, [3, 1, 1, 2, 3, 3]), "v", buckets=buckets).collect()
    assert sorted((r["value"], r["n"], r["below"], r["total"]) for r in rows) == [
        (1.0, 2, 0, 6), (2.0, 1, 2, 6), (3.0, 3, 3, 6)]


def test_average_ranks(spark):
    rows = average_ranks(frame(spark, [5, 5, 1, 9]), "v").collect()
    assert {r["value"]: r["rank"] for r in rows} == {1.0: 1.0, 5.0: 2.5, 9.0: 4.0}


def test_no_rows(spark):
    assert quantiles(frame(spark, []), "v", {"m": 0.5}, ["g"]).count() == 0


def test_an_extreme_value_does_not_gather_the_others(spark):
    """Buckets follow the values, so none holds more than a small part of them."""
    df = spark.range(20_000).select((F.col("id") / 1000).alias("v")).union(spark.createDataFrame([(1e15,)], "v double"))
    counted = cumulative_counts(df, "v", keep_bucket=True)
    assert counted.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 20_000 / 128 * 2


def test_the_input_is_shuffled_once_and_nothing_is_stored(spark, tmp_path):
    """All three readers of the folded values reuse one exchange."""
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") % 911).cast("double").alias("v"))
    result = quantiles(df, "v", PROBS, ["g"])
    assert not result.inputFiles()
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Range (0, 5000") + final.count("Scan ExistingRDD") <= 1, final
