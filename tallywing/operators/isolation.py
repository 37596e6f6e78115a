"""Isolation forest (Liu, Ting, Zhou 2008) over per-user usage."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numeric import ratio, rounded
from tallywing.model import Warehouse
from tallywing.operators.common import scalar, with_employee
from tallywing.operators.ranking import quantiles
from tallywing.operators.stats import standardize
from tallywing.session import materialize

USAGE_FEATURES = ["sessions", "api_calls", "total_cost", "avg_turns", "avg_duration", "errors"]

_EULER = 0.5772156649015329
_NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left_child int, "
                "right_child int, size int")


def user_usage_features(wh: Warehouse) -> DataFrame:
    """Per user: sessions, calls, cost, mean turns and minutes, errors (0 without any)."""
    usage = wh.sessions.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("num_api_calls").alias("api_calls"),
        rounded(F.sum("total_cost_usd"), 4).alias("total_cost"),
        rounded(ratio(F.sum("num_turns"), F.count("num_turns")), 2).alias("avg_turns"),
        rounded(ratio(F.sum("duration_min"), F.count("duration_min")), 2).alias("avg_duration"))
    errors = wh.api_errors.groupBy("user_email").agg(F.count(F.lit(1)).alias("errors"))
    return usage.join(errors, "user_email", "left").na.fill(0, ["errors"])


def path_normaliser(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype="float64")
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + _EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, tree: int) -> pd.DataFrame:
    """One tree as a node table; children lie behind their parent."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list] = []
    waiting = [(points, 0)]
    while len(nodes) < len(waiting):
        node = len(nodes)
        rows, depth = waiting[node]
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (points[0], points[0])
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            nodes.append([tree, node, -1, 0.0, -1, -1, len(rows)])
            continue
        feature = int(varying[rng.integers(len(varying))])
        cut = float(rng.uniform(low[feature], high[feature]))
        below = rows[:, feature] <= cut
        nodes.append([tree, node, feature, cut, len(waiting), len(waiting) + 1, len(rows)])
        waiting += [(rows[below], depth + 1), (rows[~below], depth + 1)]
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODE_SCHEMA.split(", ")])


def grow_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 200,
                sample: int = 256, seed: int = 42) -> DataFrame:
    """Node table of ``trees`` trees, each grown from ``sample`` rows without replacement.

    Every row draws, per tree, a number from a hash of its key. Rows below a threshold
    that about ``2·sample`` rows pass go to that tree, and the ``sample`` smallest stay.
    So only some hundred rows per tree are shuffled, however long the table is, and the
    draw depends neither on partitioning nor on retries. A tree holds at most
    ``2·sample`` nodes, which bounds the whole table.
    """
    n = scalar(df, F.count(F.lit(1)))
    space = float(2 ** 53)

    def draw(tree):
        return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed), tree), 11) / space

    share = F.least(F.lit(1.0), F.lit(2.0 * sample + 64) / F.greatest(n, F.lit(1)))
    rows = df.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("point"),
                     share.alias("share"))
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.col("share"))
    # An explicit number of partitions: trees are grown in parallel although the rows are few.
    slots = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    drawn = rows.select(key, "point", F.explode(picks).alias("tree")).repartition(slots, "tree")
    entry = F.struct(draw(F.col("tree")).alias("draw"), key, "point")
    # At most some 600 rows meet per tree.
    bags = drawn.groupBy("tree").agg(
        F.slice(F.sort_array(F.collect_list(entry)), 1, sample).alias("bag"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree, bag in zip(batch["tree"], batch["points"]):
                points = np.array([list(p) for p in bag], dtype="float64")
                yield _grow(points, np.random.default_rng([seed, int(tree)]), int(tree))

    points = bags.select("tree", F.transform("bag", lambda e: e["point"]).alias("points"))
    return points.mapInPandas(build, _NODE_SCHEMA)


def score_rows(df: DataFrame, features: Sequence[str], nodes: pd.DataFrame,
               output: str = "anomaly_score") -> DataFrame:
    """Add the score of each row, in (−1, 0): the lower, the easier it is to isolate."""
    nodes = nodes.sort_values(["tree", "node"])
    forest = [part.drop(columns=["tree", "node"]).to_numpy().T for _, part in nodes.groupby("tree")]
    norm = float(path_normaliser(max(part[4].max() for part in forest)))
    names = list(features)

    def depth(points: np.ndarray, tree: np.ndarray) -> np.ndarray:
        feature, cut, left, right, size = tree
        at = np.zeros(len(points), dtype="int64")
        steps = np.zeros(len(points))
        inner = feature[at] >= 0
        while inner.any():
            here = at[inner]
            below = points[inner, feature[here].astype("int64")] <= cut[here]
            at[inner] = np.where(below, left[here], right[here]).astype("int64")
            steps[inner] += 1
            inner = feature[at] >= 0
        return steps + path_normaliser(size[at])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = batch[names].to_numpy(dtype="float64")
            mean_depth = sum(depth(points, tree) for tree in forest) / len(forest)
            yield batch.assign(**{output: -np.power(2.0, -mean_depth / max(norm, 1e-12))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(score, f"{schema}, `{output}` double")


def flag_anomalies(scored: DataFrame, contamination: float = 0.1,
                   score: str = "anomaly_score") -> DataFrame:
    """Label the lowest ``contamination`` share −1 and grade −score into three equal bands."""
    cut = quantiles(scored, score, {"cut": contamination}).scalar()
    ends = scalar(scored, F.struct(F.min(score).alias("low"), F.max(score).alias("high")))
    rows = scored.withColumns({"_cut": cut, "_ends": ends}).select(
        *scored.columns, "_cut", F.col("_ends.low").alias("_low"),
        ((F.col("_ends.high") - F.col("_ends.low")) / 3).alias("_third"))
    odd = F.col(score) < F.col("_cut")
    severity = (F.when(F.col(score) >= F.col("_low") + 2 * F.col("_third"), "Low")
                .when(F.col(score) >= F.col("_low") + F.col("_third"), "Medium").otherwise("High"))
    return rows.withColumns({
        "anomaly_label": F.when(odd, -1).otherwise(1), "is_anomaly": odd,
        "anomaly_severity": severity}).drop("_cut", "_low", "_third")


def detect_user_anomalies(wh: Warehouse, trees: int = 200, sample: int = 256,
                          contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Usage rows with score, label and severity, the most unusual first.

    The node table, bounded by ``trees · 2·sample`` rows, is the only thing collected.
    """
    users = materialize(user_usage_features(wh), "usage")
    scaled = standardize(users.na.fill(0, USAGE_FEATURES), USAGE_FEATURES)
    names = [f"{c}_z" for c in USAGE_FEATURES]
    nodes = grow_forest(scaled, "user_email", names, trees, sample, seed).toPandas()
    if nodes.empty:
        raise ValueError("no users to score")
    scored = materialize(score_rows(scaled, names, nodes).drop(*names), "scores")
    return with_employee(flag_anomalies(scored, contamination), wh, "practice", "level", "full_name",
                         how="left").orderBy("anomaly_score", "user_email")


def anomaly_share(anomalies: DataFrame) -> DataFrame:
    """One row: users, flagged users and their share in percent."""
    flagged = F.count_if("is_anomaly")
    return anomalies.agg(F.count(F.lit(1)).alias("users"), flagged.alias("flagged"),
                         rounded(100 * ratio(flagged, F.count(F.lit(1))), 1).alias("flagged_pct"))
