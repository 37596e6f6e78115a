"""K-means with all restarts in one pass over the points per round.

A pass assigns each point to its nearest centre for every restart at once and sums the
points per (restart, cluster) inside the task before anything is shuffled. The driver
holds the centres only: ``restarts`` times ``k`` vectors, whatever the number of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    """The restart of least cost: ``centres`` is k by dimensions; ``passes`` read the points."""

    centres: np.ndarray
    cost: float
    passes: int


def _uniform(ids: np.ndarray, restart: int, step: int) -> np.ndarray:
    """A number in (0, 1) per id that depends on nothing but the arguments (splitmix64)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + 1009 * restart + step)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)) + 0.5) * 2.0 ** -53


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres."""
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _next_centres(points: DataFrame, columns: Sequence[str], centres: np.ndarray) -> np.ndarray:
    """One more centre per restart, drawn in proportion to the squared distance.

    Each point runs a race with an exponential clock of that rate; the first one home is
    such a draw, and the least of minima needs no total over the points.
    """
    restarts, step = centres.shape[:2]
    names = list(columns)

    def race(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, ids = batch[names].to_numpy(float), batch["id"].to_numpy()
            for r in range(restarts):
                rate = _squares(x, centres[r]).min(axis=1) if step else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    clock = -np.log(_uniform(ids, r, step)) / rate
                best = np.lexsort((ids, clock))[0] if len(x) else None
                if best is not None:
                    yield pd.DataFrame({"restart": [r], "clock": [clock[best]], "id": [ids[best]],
                                        "x": [x[best]]})

    first = points.mapInPandas(race, "restart int, clock double, id bigint, x array<double>")
    won = first.groupBy("restart").agg(F.min(F.struct("clock", "id", "x")).alias("best")).collect()
    drawn = {row["restart"]: row["best"]["x"] for row in won}
    if not drawn:
        raise ValueError("no points to cluster")
    return np.array([drawn[r] for r in range(restarts)])


def _sums(points: DataFrame, columns: Sequence[str], centres: np.ndarray,
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per restart and cluster the count and sum of its points, per restart the cost."""
    restarts, k, dims = centres.shape
    names, parts = list(columns), [f"s{j}" for j in range(dims)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, cost, sums = np.zeros((restarts, k)), np.zeros((restarts, k)), np.zeros((restarts, k, dims))
        for batch in batches:
            x = batch[names].to_numpy(float)
            for r in range(restarts):
                squares = _squares(x, centres[r])
                to = squares.argmin(axis=1)
                n[r] += np.bincount(to, minlength=k)
                cost[r] += np.bincount(to, squares[np.arange(len(x)), to], minlength=k)
                for j in range(dims):
                    sums[r, :, j] += np.bincount(to, x[:, j], minlength=k)
        r, c = np.nonzero(n)
        yield pd.DataFrame({"restart": r, "cluster": c, "n": n[r, c].astype(np.int64), "cost": cost[r, c],
                            **{p: sums[r, c, j] for j, p in enumerate(parts)}})

    schema = "restart int, cluster int, n bigint, cost double, " + ", ".join(f"{p} double" for p in parts)
    rows = points.mapInPandas(fold, schema).groupBy("restart", "cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"),
        *[F.sum(p).alias(p) for p in parts]).collect()
    n, cost, sums = np.zeros((restarts, k)), np.zeros(restarts), np.zeros((restarts, k, dims))
    for row in rows:
        r, c = row["restart"], row["cluster"]
        n[r, c], sums[r, c] = row["n"], [row[p] for p in parts]
        cost[r] += row["cost"]
    return n, sums, cost


def fit_kmeans(points: DataFrame, columns: Sequence[str], k: int, restarts: int = 20,
               rounds: int = 300, tol: float = 1e-4,
               watch: Callable[[int, int], None] | None = None) -> Fit:
    """The centres of least cost out of ``restarts`` seedings by squared distance.

    ``points`` holds ``id`` (bigint, a hash of the row's key: equal ids draw equal numbers)
    and the ``columns`` as doubles without nulls; it is read ``k`` times for the seeds, once
    a round and once for the costs, so store it first. A restart rests once no centre moves
    by more than ``tol``. A cluster left without points keeps its centre; with fewer than
    ``k`` distinct points some centres are equal. Costs that agree in nine digits are a tie,
    which the first such restart wins. No points at all are an error. ``watch`` is told
    the round and how many restarts still move.
    """
    if k < 1 or restarts < 1:
        raise ValueError("k and restarts must be positive")
    points = points.select("id", *columns)
    centres = np.zeros((restarts, 0, len(columns)))
    for _ in range(k):
        centres = np.concatenate([centres, _next_centres(points, columns, centres)[:, None, :]], axis=1)
    passes, moving = k, np.arange(restarts)
    for number in range(rounds):
        if not len(moving):
            break
        n, sums, _ = _sums(points, columns, centres[moving])
        passes += 1
        moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres[moving])
        step = np.sqrt(((moved - centres[moving]) ** 2).sum(axis=2)).max(axis=1)
        centres[moving] = moved
        moving = moving[step > tol]
        if watch:
            watch(number, len(moving))
    cost = _sums(points, columns, centres)[2]
    least = cost.min()
    best = int(np.flatnonzero(cost <= least + 1e-9 * max(least, 1e-300))[0])
    return Fit(centres[best], float(cost[best]), passes + 1)
