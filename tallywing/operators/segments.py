"""User segmentation with k-means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numeric import rounded
from tallywing.model import SEGMENT_LABELS, Warehouse
from tallywing.operators.kmeans import fit_kmeans
from tallywing.operators.people import user_engagement_scores
from tallywing.operators.stats import standardize
from tallywing.session import materialize

FEATURES = ["sessions", "avg_turns", "total_cost", "distinct_tools"]


def _squared(columns: list[str], point: list[float]) -> Column:
    return sum(((F.col(c).cast("double") - F.lit(float(v))) * (F.col(c).cast("double") - F.lit(float(v)))
                for c, v in zip(columns, point)), F.lit(0.0))


def cluster_users(wh: Warehouse, k: int = 4, restarts: int = 20, seed: int = 42,
                  fanout: bool = False) -> DataFrame:
    """Engagement rows with cluster number, label and distance to the centroid.

    Clusters are numbered and labelled by descending mean cost; one without users gets no
    number. The distance is in the units of the features. Seeds are drawn by user, so a
    seed gives the same segments on any layout of the input. Users are stored before the
    fit; only the centres of all restarts and the means of k clusters reach the driver.
    """
    users = user_engagement_scores(wh, fanout=fanout)
    scaled = [f"{c}_z" for c in FEATURES]
    stored = materialize(standardize(users.na.fill(0, FEATURES), FEATURES), "engagement")
    points = stored.select(F.xxhash64("user_email", F.lit(seed)).alias("id"), *scaled)
    centres = fit_kmeans(points, scaled, k, restarts).centres
    away = F.array(*[_squared(scaled, list(c)) for c in centres])
    placed = stored.withColumn("_away", away).withColumn(
        "_found", (F.array_position("_away", F.array_min("_away")) - 1).cast("int")).drop("_away", *scaled)
    means = placed.groupBy("_found").agg(*[F.avg(c).cast("double").alias(c) for c in FEATURES]).collect()
    ranked = sorted(means, key=lambda m: (-m["total_cost"], m["_found"]))
    number = F.element_at(F.create_map(*[F.lit(x) for no, m in enumerate(ranked)
                                         for x in (m["_found"], no)]), F.col("_found"))
    label = F.get(F.array(*[F.lit(x) for x in SEGMENT_LABELS]), F.col("cluster"))
    distance = F.get(F.array(*[F.sqrt(_squared(FEATURES, [m[c] for c in FEATURES])) for m in ranked]),
                     F.col("cluster"))
    return placed.withColumn("cluster", number.cast("int")).withColumns({
        "cluster_label": label, "dist_to_centroid": rounded(distance, 3)}).drop("_found")


def cluster_profile(clusters: DataFrame) -> DataFrame:
    """Size and feature means per segment."""
    means = {"avg_sessions": "sessions", "avg_cost": "total_cost", "avg_turns": "avg_turns",
             "avg_tools": "distinct_tools", "avg_score": "engagement_score"}
    return clusters.groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("engineers"),
        *[rounded(F.avg(c), 2).alias(n) for n, c in means.items()],
    ).orderBy(F.desc("engineers"), "cluster_label")
