"""Nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a set of pivots, nearest first. The
index is dealt into blocks of bounded size. In a block every vector is posted in the inverted
files of its ``POSTED`` nearest pivots. A query reads the files of its own nearest pivots,
ranks what it finds by the footrule distance between whole orders (the sum of how far each
pivot moved), and measures the best ``SHARE`` of the block, ``LEAST_RANKED`` at least, on the
original vectors. Each block hands on its nearest for each query; the nearest of those remain.

Blocks of queries meet blocks of the index, so no group grows with the data. Equal vectors
are indexed once, with as many of their smallest ids as an answer can need. Each of
the ``LENGTHS`` commonest vector lengths has pivots of its own, at most ``PIVOTS`` of its vectors, those
with the least hash; every vector is indexed. The share, not
a number, is what keeps recall at any size: among vectors without structure a number would
lose more neighbours the more vectors there are.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id; vectors of another length are searched among themselves, all of them exactly where
their length has no pivots. Rows with equal
id and vector count once. Ties go to the smaller id. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywing.session import materialize

PIVOTS, LENGTHS, POSTED, SHARE, LEAST_RANKED = 256, 16, 24, 0.1, 250
BLOCK, QUERY_BLOCK = 16_384, 2_048


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def orders(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot in every vector's order; of equally near pivots the earlier first."""
    if not len(pivots):
        return np.zeros((len(vectors), 0), np.uint8)
    far = (pivots ** 2).sum(1)[None, :] - 2 * vectors @ pivots.T
    places = np.empty(far.shape, np.uint8)
    np.put_along_axis(places, far.argsort(axis=1, kind="stable"), np.arange(len(pivots), dtype=np.uint8)[None, :], axis=1)
    return places


class InvertedFiles:
    """Vectors of a block under each of their nearest pivots."""

    def __init__(self, places: np.ndarray, posted: int) -> None:
        self.places = places.astype(np.int16)
        row, pivot = np.nonzero(places < posted)
        by_pivot = np.argsort(pivot, kind="stable")
        self._rows = row[by_pivot]
        self._starts = np.searchsorted(pivot[by_pivot], np.arange(places.shape[1] + 1))
        self._posted = posted

    def ranked(self, order: np.ndarray, number: int) -> np.ndarray:
        """Up to ``number`` posted vectors by footrule distance; every vector if there are no pivots."""
        if not self.places.shape[1]:
            return np.arange(len(self.places))
        seen = np.zeros(len(self.places), bool)
        for pivot in np.flatnonzero(order < self._posted):
            seen[self._rows[self._starts[pivot]:self._starts[pivot + 1]]] = True
        found = np.flatnonzero(seen)
        if len(found) <= number:
            return found
        rule = np.abs(self.places[found] - order.astype(np.int16)).sum(axis=1, dtype=np.int32)
        return found[np.argpartition(rule, number - 1)[:number]]


def _with_orders(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``places``, a byte per pivot of the vector's length."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places: list[bytes] = [b""] * len(batch)
            lengths = batch["vector"].map(len).to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                stack = np.stack([np.asarray(batch["vector"].iloc[k], float) for k in at])
                for k, row in zip(at, orders(stack, pivots.get(int(length), np.empty((0, length))))):
                    places[k] = row.tobytes()
            yield batch.assign(places=pd.Series(places, index=batch.index, dtype=object))

    return vectors.mapInPandas(rows, "first_id bigint, ids array<bigint>, vector array<double>, places binary")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, share: float = SHARE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the ``k`` nearest found.

    ``embeddings``: vec_id, embedding; ``is_query`` tells queries by their columns."""
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
                              is_query.alias("asks"))
    valid = given.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    single = valid.select("vec_id", "vector").distinct()
    # The k + 1 smallest ids of a vector: Spark keeps that many per vector before it shuffles.
    few = single.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    vectors = materialize(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
                          .select(F.col("ids")[0].alias("first_id"), "ids", "vector"), "vectors")
    if not 0 < pivots <= 256:
        raise ValueError(f"an order has 1 to 256 pivots, not {pivots}")
    sized = vectors.withColumn("length", F.size("vector"))
    common = sized.groupBy("length").count().orderBy(F.desc("count"), "length").limit(LENGTHS).select("length")
    by_hash = Window.partitionBy("length").orderBy(F.xxhash64("vector"), "first_id")
    # Spark keeps that many rows per length before it shuffles.
    chosen = sized.join(common, "length", "left_semi").withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= pivots) \
        .orderBy("length", "n").select("vector").collect()
    by_length: dict[int, list] = {}
    for row in chosen:
        by_length.setdefault(len(row["vector"]), []).append(row["vector"])
    index = materialize(_with_orders(vectors, {n: np.asarray(v, float) for n, v in by_length.items()}), "permutations")
    asking = valid.filter("asks").select("vec_id", "vector").distinct() \
        .join(vectors.select("vector", "first_id"), "vector").select(F.col("vec_id").alias("query_id"), "first_id")
    asking = materialize(asking, "queries")
    asked = index.join(asking.select("first_id").distinct(), "first_id", "left_semi")
    blocks = max(1, -(-index.count() // BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def block(number: int) -> Column:
        return F.pmod(F.xxhash64("first_id"), F.lit(number))

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    left = index.select(F.size("vector").alias("length"), block(blocks).cast("int").alias("block"), every(query_blocks).alias("query_block"),
                        "ids", "vector", "places")
    right = asked.select(F.size("vector").alias("length"), every(blocks).alias("block"), block(query_blocks).cast("int").alias("query_block"),
                         "first_id", F.col("vector").alias("asked_vector"), F.col("places").alias("asked_places"))

    def search(indexed: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(indexed) and len(queries):
            stack = np.stack(indexed["vector"].to_list()).astype(float)
            places = np.stack([np.frombuffer(p, np.uint8) for p in indexed["places"]])
            files, ids = InvertedFiles(places, POSTED), indexed["ids"].to_list()
            first = np.asarray([i[0] for i in ids])
            number = max(LEAST_RANKED, int(np.ceil(share * len(indexed))))
            for name, vector, order in zip(queries["first_id"], queries["asked_vector"], queries["asked_places"]):
                found = files.ranked(np.frombuffer(order, np.uint8), number)
                score = np.sqrt(((stack[found] - np.asarray(vector, float)) ** 2).sum(axis=1))
                # Each vector has at least one id besides the query's, but for the query's own.
                best = np.lexsort((first[found], score))[:k + 1]
                rows = sorted((float(score[b]), int(i)) for b in best for i in ids[found[b]])[:k + 1]
                out.append(pd.DataFrame({"first_id": name, "vec_id": [i for _, i in rows], "score": [s for s, _ in rows]}))
        return pd.concat(out) if out else pd.DataFrame({"first_id": [], "vec_id": [], "score": []}).astype(
            {"first_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ("length", "block", "query_block")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "first_id bigint, vec_id bigint, score double")
    by_vector = Window.partitionBy("first_id").orderBy("score", "vec_id")
    kept = near.withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1).drop("n")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return asking.join(kept, "first_id").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(by_query)) \
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
