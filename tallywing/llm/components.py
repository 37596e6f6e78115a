"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywing.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the least node it knows."""
    both = edges.union(edges.select("low", "high")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and takes itself, the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    moved = edges.join(least, "high").filter("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return moved.union(least.select("high", F.col("m").alias("low"))).distinct()


def _seal(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low")),
                           F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node reachable) for every node with an edge to another.

    Rounds are stored in the shared folder, so a lost executor costs no earlier round; their
    number grows with the logarithm of the longest path. The least node of a component may
    neighbour all others: minima are combined before the shuffle, and the join that hands
    them on is one that adaptive execution splits. Edges with a null end are left out.
    """
    own = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")) \
        .filter(f"`{a}` is not null and `{b}` is not null and high <> low").distinct()
    current = materialize(own, "edges")
    seal = _seal(current)
    while seal[0]:
        following = materialize(_small_star(_large_star(current)), "stars")
        before, seal = seal, _seal(following)
        current = following
        if seal == before:
            break
    members = current.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return members.union(current.select("low", "low").distinct())
