import random

import numpy as np
import pytest
from builders import at, make, rows, sessions
from pyspark.sql import functions as F

from tallywing.operators import behavior, isolation, kmeans, segments
from tallywing.operators.stats import standardize
from tallywing.plans.science_queries import anomaly_violations, segment_violations
from tallywing.session import materialize


@pytest.fixture(scope="module")
def crowd(spark):
    """60 ordinary users in four clear groups and one who is far off."""
    rng = random.Random(11)
    out, staff = [], []
    for n in range(60):
        group = n % 4
        staff.append({"email": f"u{n:02d}"})
        for k in range(2 + 2 * group):
            out.append({"user_email": f"u{n:02d}", "start_time": at(f"2024-01-{k + 1:02d}"),
                        "total_cost_usd": 5.0 * (group + 1) + rng.random(),
                        "num_turns": 1 + group, "duration_min": 10.0 + rng.random()})
    staff.append({"email": "odd"})
    out += [{"user_email": "odd", "start_time": at(f"2024-01-{k % 28 + 1:02d}"),
             "total_cost_usd": 400.0, "num_turns": 60, "duration_min": 300.0} for k in range(90)]
    return make(spark, employees=staff, sessions=sessions(spark, out))


def test_forest_shape(spark, crowd):
    users = isolation.user_usage_features(crowd)
    nodes = isolation.grow_forest(users, "user_email", isolation.USAGE_FEATURES, trees=9,
                                  sample=16, seed=1).toPandas()
    assert sorted(nodes["tree"].unique()) == list(range(9))
    for _, tree in nodes.groupby("tree"):
        assert tree.loc[tree["node"] == 0, "size"].item() == 16
        leaves = tree[tree["feature"] < 0]
        assert leaves["size"].sum() == 16 and len(tree) <= 2 * 16
        inner = tree[tree["feature"] >= 0]
        assert (inner["left_child"] > inner["node"]).all()


def test_path_normaliser():
    got = isolation.path_normaliser(np.array([0, 1, 2, 256]))
    assert list(got[:3]) == [0, 0, 1] and got[3] == pytest.approx(10.244, abs=1e-3)


def test_the_odd_user_comes_first_and_a_tenth_is_flagged(spark, crowd):
    got = rows(isolation.detect_user_anomalies(crowd, trees=60))
    assert got[0]["user_email"] == "odd" and got[0]["anomaly_severity"] == "High"
    assert all(-1 < r["anomaly_score"] < 0 for r in got)
    flagged = [r for r in got if r["is_anomaly"]]
    assert 4 <= len(flagged) <= 7
    assert {r["anomaly_label"] for r in flagged} == {-1}
    again = rows(isolation.detect_user_anomalies(crowd, trees=60))
    assert [r["anomaly_score"] for r in again] == [r["anomaly_score"] for r in got]


def test_forest_does_not_depend_on_partitioning(spark, crowd):
    users = standardize(isolation.user_usage_features(crowd), isolation.USAGE_FEATURES)
    names = [f"{c}_z" for c in isolation.USAGE_FEATURES]

    def grown(df):
        nodes = isolation.grow_forest(df, "user_email", names, trees=5, sample=32).toPandas()
        return nodes.sort_values(["tree", "node"]).reset_index(drop=True)

    one, many = grown(users.coalesce(1)), grown(users.repartition(13))
    assert one[["feature", "size"]].equals(many[["feature", "size"]])


def test_share(spark):
    df = spark.createDataFrame([(True,), (False,), (False,)], "is_anomaly boolean")
    assert rows(isolation.anomaly_share(df)) == [{"users": 3, "flagged": 1, "flagged_pct": 33.3}]


def test_segments(spark, crowd):
    clusters = segments.cluster_users(crowd, restarts=4)
    got = rows(clusters)
    by_label = {}
    for r in got:
        by_label.setdefault(r["cluster_label"], []).append(r)
    assert list(segments.SEGMENT_LABELS) == sorted(
        by_label, key=lambda k: -np.mean([r["total_cost"] for r in by_label[k]]))
    for members in by_label.values():
        centre = np.mean([[r[f] for f in segments.FEATURES] for r in members], axis=0)
        for r in members:
            away = np.linalg.norm([r[f] - c for f, c in zip(segments.FEATURES, centre)])
            assert r["dist_to_centroid"] == pytest.approx(away, abs=2e-3)
    again = {r["user_email"]: r["cluster_label"] for r in rows(
        segments.cluster_users(crowd, restarts=4))}
    assert again == {r["user_email"]: r["cluster_label"] for r in got}
    profile = rows(segments.cluster_profile(clusters))
    assert sum(r["engineers"] for r in profile) == 61
    rolled = rows(behavior.rolling_sessions_by_cluster(crowd, clusters))
    assert sum(r["sessions"] for r in rolled) == crowd.sessions.count()


def _blobs(spark, groups=4, size=150, spread=0.6):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (groups, 3))
    points = np.concatenate([rng.normal(c, spread, (size, 3)) for c in centres])
    return points, spark.createDataFrame(
        [(n, *map(float, p)) for n, p in enumerate(points)], "id bigint, a double, b double, c double")


def test_kmeans_reaches_the_least_cost_of_separate_fits(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points, df = _blobs(spark, groups=7, spread=1.5)
    fit = kmeans.fit_kmeans(df, ["a", "b", "c"], k=5, restarts=20)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df).cache()
    apart = min(KMeans(k=5, seed=s, featuresCol="v", maxIter=300, tol=1e-4).fit(vectors)
                .summary.trainingCost for s in range(20))
    assert fit.cost <= apart * (1 + 1e-4)  # both are local searches from random seeds
    squares = ((points[:, None, :] - fit.centres[None]) ** 2).sum(axis=2)
    assert fit.cost == pytest.approx(squares.min(axis=1).sum())
    for c in range(5):  # a fixed point: every centre is the mean of the points nearest to it
        assert points[squares.argmin(axis=1) == c].mean(axis=0) == pytest.approx(fit.centres[c], abs=1e-3)


def test_kmeans_passes_do_not_grow_with_restarts(spark):
    _, df = _blobs(spark)
    rounds = []
    many = kmeans.fit_kmeans(df, ["a", "b", "c"], k=4, restarts=30,
                             watch=lambda number, moving: rounds.append(moving))
    assert many.passes == 4 + len(rounds) + 1
    assert rounds[-1] == 0 and rounds == sorted(rounds, reverse=True)
    layouts = [kmeans.fit_kmeans(df.repartition(n), ["a", "b", "c"], k=4, restarts=3).centres for n in (1, 9)]
    assert layouts[0] == pytest.approx(layouts[1])


def test_kmeans_with_few_or_no_points(spark):
    df = spark.createDataFrame([(n, float(n % 2)) for n in range(6)], "id bigint, a double")
    fit = kmeans.fit_kmeans(df, ["a"], k=3, restarts=2)
    assert fit.cost == 0 and sorted(set(fit.centres[:, 0])) == [0.0, 1.0]
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(df.limit(0), ["a"], k=2)


def test_invariants_see_wrong_results(spark, crowd):
    clusters = segments.cluster_users(crowd, restarts=3)
    (right,) = rows(segment_violations(clusters))
    assert (right["users"], right["labels"]) == (61, 4)
    assert (right["nearer_elsewhere"], right["wrong_distance"], right["out_of_order"]) == (0, 0, 0)
    odd = F.col("user_email") == "odd"
    (moved,) = rows(segment_violations(clusters.withColumn("cluster", F.when(odd, 3).otherwise(F.col("cluster")))))
    assert moved["nearer_elsewhere"] > 0 and moved["wrong_distance"] > 0
    (turned,) = rows(segment_violations(clusters.withColumn("cluster", 3 - F.col("cluster"))))
    assert turned["out_of_order"] == 61
    found = materialize(isolation.detect_user_anomalies(crowd, trees=30), "found")
    clean = {"users": 61, "flagged_above_kept": 0, "wrong_severity": 0, "wrong_label": 0, "wrong_number": 0}
    assert rows(anomaly_violations(found)) == [clean]
    (none,) = rows(anomaly_violations(found.withColumn("is_anomaly", F.lit(False))))
    assert none["wrong_label"] > 0 and none["wrong_number"] == 1
    (graded,) = rows(anomaly_violations(found.withColumn("anomaly_severity", F.lit("Low"))))
    assert graded["wrong_severity"] > 0
