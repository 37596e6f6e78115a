"""Near duplicates on word shingles: one-permutation hashing, bands, star-shaped candidates.

Every document's shingles are hashed once. The hash range is cut into bins, the least value
of each bin is the sketch, and an empty bin borrows from a filled one in an order that is
fixed for the bin and random over bins (optimal densification). Sketches are cut into bands;
documents with an equal band share a bucket.

Documents with the very same shingle set are one class, so copies never meet in a bucket.
A bucket's pairs are bounded by a star: its members are paired with its least one only and
compared on full shingle sets; links are merged into components. Most buckets then hold one
component and are done with. The others' members are compared across components in place,
with their shingle sets: those of buckets that overlap form a family, which is brought together
in blocks of bounded size, each member once; a family of more than ``LARGE`` members is taken
bucket by bucket instead, a pair in the first band it shares only. Pairs that a chain of links
joins already are passed over. Only links leave that step, so no link between bucket members is
lost and no pair is ever a row.

With 48 bands of 6 bins, two sets with a similarity of 0.8 share no bucket once in two
million pairs; more similar ones far less often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallywing.llm.components import connected_components
from tallywing.llm.tokens import lean, slices
from tallywing.session import materialize

BANDS, ROWS = 48, 6
BLOCK, LARGE = 1024, 8192
SENT_IDS = 2_000_000
_BATCH_CHARS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (run without ASCII white space) and the words per text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(blank, prepend=True)
    at = np.flatnonzero(edges)
    starts, ends = at[0::2], at[1::2]
    powers = np.full(len(data), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * powers)])
    inverse = np.full(len(data), _BASE_INVERSE, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, limits), prepend=0)


def shingle_sets(texts: Sequence[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width`` consecutive words, A-Z lower-cased.

    A text with fewer words has its whole sequence as one shingle, one without words none."""
    for part in slices(texts, _BATCH_CHARS):
        hashes, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[part]])
        joined = hashes.copy()
        for k in range(1, width):
            joined = mix(joined[:len(hashes) - k] * _STEP + hashes[k:]) if len(hashes) > k else joined[:0]
        start = 0
        for count in counts:
            if count >= width:
                yield np.unique(joined[start:start + count - width + 1])
            elif count:
                yield mix(np.asarray([int(count)] , np.uint64) + np.frombuffer(
                    hashlib.blake2b(hashes[start:start + count].tobytes(), digest_size=8).digest(), np.uint64))
            else:
                yield np.empty(0, np.uint64)
            start += count


class Sketcher:
    """Band keys of a shingle set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        self.bands, self.bins = bands, bands * rows
        rng = np.random.default_rng(20_241_107)
        self._lenders = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.uint16)
        self._turn = np.empty_like(self._lenders)
        np.put_along_axis(self._turn, self._lenders, np.arange(self.bins, dtype=np.uint16)[None, :], axis=1)
        self._salts = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of every bin; ``shingles`` are sorted and not empty."""
        bins = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(bins, prepend=np.uint64(1 << 40)))
        filled = bins[first].astype(np.int64)
        values = np.zeros(self.bins, np.uint64)
        values[filled] = shingles[first]
        if len(filled) < self.bins:
            empty = np.ones(self.bins, bool)
            empty[filled] = False
            lacking = np.flatnonzero(empty)
            values[lacking] = values[filled[self._turn[np.ix_(lacking, filled)].argmin(axis=1)]]
        return values

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.sketch(shingles).reshape(self.bands, -1)
        key = self._salts.copy()
        for k in range(rows.shape[1]):
            key = mix(key * _STEP + rows[:, k])
        return key.view(np.int64)


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (left_semi) or without (left_anti) one of ``ids``, one column doc_id.

    At most ``SENT_IDS`` distinct ids are sent to where the texts lie; more are joined by shuffle."""
    stored = materialize(ids.select("doc_id").distinct(), "ids")
    few = stored.count() <= SENT_IDS
    return docs.join(F.broadcast(stored) if few else stored, "doc_id", how).select(*docs.columns)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set (null if empty), band keys."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher()
        for batch in batches:
            sizes, digests, keys = [], [], []
            for shingles in shingle_sets(batch["text"].tolist(), width):
                sizes.append(len(shingles))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                keys.append(sketcher.keys(shingles) if len(shingles) else [])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": sizes,
                                "digest": pd.Series(digests, dtype=object), "keys": pd.Series(keys, dtype=object)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        lean(rows), "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full shingle sets are similar enough."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text_a"].tolist() + batch["text_b"].tolist()
            place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            sets = list(shingle_sets(list(place), width))
            linked = []
            for x, y in zip(batch["text_a"], batch["text_b"]):
                p, q = sets[place[x]], sets[place[y]]
                common = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(bool(common) and 100 * common >= percent * (len(p) + len(q) - common))
            yield batch.loc[linked, ["a", "b"]]

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = materialize(by_ids(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "left_semi"), "texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(lean(rows), "a bigint, b bigint").distinct()


def _star_pairs(buckets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of every bucket's least member with the others, unless their sizes rule a link out."""
    centres = buckets.groupBy("key").agg(F.min("member").alias("a"))
    pairs = buckets.join(centres, "key").filter("member > a").select("a", F.col("member").alias("b")).distinct()
    of_a, of_b = (sizes.select(F.col("member").alias(x), F.col("least").alias(f"least_{x}"), F.col("most").alias(f"most_{x}"))
                  for x in "ab")
    return pairs.join(of_a, "a").join(of_b, "b").filter(
        100 * F.least("most_a", "most_b") >= percent * F.greatest("least_a", "least_b")).select("a", "b")


def _links_inside(at: tuple[int, bool, int, int], rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between members of one block, or from one block to another, across components.

    ``at``: a family, or a bucket's key, which of them, and the two blocks; ``rows``: member,
    component, block, shingles, band keys."""
    group, is_family, x, y = at
    root: dict[int, int] = {r[1]: r[1] for r in rows}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.asarray([len(x) for x in sets])
    keys = np.stack([np.asarray(r[4], np.int64) for r in rows])
    blocks = np.asarray([r[2] for r in rows])
    band = int((keys[0] == group).argmax())
    links: list[tuple[int, int]] = []
    for k in range(len(rows) - 1):
        equal = keys[k + 1:] == keys[k]
        fit = equal.any(axis=1) if is_family else (equal.argmax(axis=1) == band) & equal[:, band]
        low, high = np.minimum(sizes[k + 1:], sizes[k]), np.maximum(sizes[k + 1:], sizes[k])
        fit &= 100 * low >= percent * high
        if x != y:
            fit &= blocks[k + 1:] != blocks[k]
        for n in np.flatnonzero(fit) + k + 1:
            here, there = find(rows[k][1]), find(rows[n][1])
            if here != there:
                common = len(np.intersect1d(sets[k], sets[n], assume_unique=True))
                if 100 * common >= percent * (sizes[k] + sizes[n] - common):
                    root[here] = there
                    links.append((rows[k][0], rows[n][0]))
    return links


def _bucket_links(members: DataFrame, least: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across components inside the buckets ``members`` (key, member, component)."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(batch["text"].tolist(), width)]
            yield pd.DataFrame({"member": batch["doc_id"], "shingles": pd.Series(sets, dtype=object)})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by group; a group may go on in the next batch.
        group: list[tuple] = []
        at = None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for unit, is_family, x, y, *row in batch.itertuples(index=False, name=None):
                if (unit, is_family, x, y) != at:
                    if len(group) > 1:
                        links += _links_inside(at, group, percent)
                    group, at = [], (unit, is_family, x, y)
                group.append(tuple(row))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
        if len(group) > 1:
            yield pd.DataFrame(_links_inside(at, group, percent), columns=["a", "b"], dtype="int64")

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = by_ids(texts, members.select(F.col("member").alias("doc_id")), "left_semi") \
        .mapInPandas(lean(shingled), "member bigint, shingles binary")
    hubs = members.groupBy("key").agg(F.min("member").alias("hub"))
    families = connected_components(members.join(hubs, "key").select("member", "hub").distinct(), "member", "hub") \
        .withColumnsRenamed({"node": "member", "component": "family"})
    small = families.groupBy("family").agg((F.count("*") <= LARGE).alias("is_family"))
    placed = members.join(families.join(small, "family"), "member")
    units = placed.select(F.when(F.col("is_family"), F.col("family")).otherwise(F.col("key")).alias("unit"), "is_family",
                          "member", "component").distinct()
    blocks = units.groupBy("unit", "is_family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # A member of a large unit goes to each pair of blocks that has its own.
    dealt = units.join(blocks, ["unit", "is_family"]).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = dealt.withColumn("pair", F.explode(F.transform(other, lambda j: F.struct(
        F.least(F.col("block"), j).alias("x"), F.greatest(F.col("block"), j).alias("y")))))
    kept = least.select("member", "keys")
    full = spread.join(sets.join(kept, "member"), "member").select(
        "unit", "is_family", "pair.x", "pair.y", "member", "component", "block", "shingles", "keys")
    group = ("unit", "is_family", "x", "y")
    return full.repartition(*group).sortWithinPartitions(*group, "member") \
        .mapInPandas(lean(compared), "a bigint, b bigint").distinct()


def link_components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable, itself included).

    Null or blank texts have no shingles and no links. Rows with an equal ``doc_id`` are one
    document with several texts: any of them may link it. A null ``doc_id`` gets a null
    component and links nothing. Further columns are ignored; an empty table gives none.
    """
    stored = materialize(sketches(docs, width), "sketches")
    sets = stored.filter("digest is not null and doc_id is not null")
    classes = materialize(sets.groupBy("digest").agg(F.min("doc_id").alias("member")), "classes")
    # One row per class; the sketch of its least document.
    least = materialize(sets.join(classes, "digest").filter("doc_id = member").select("member", "n_shingles", "keys"), "least")
    sizes = least.groupBy("member").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    bands = least.select("member", F.explode("keys").alias("key")).distinct()
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = materialize(bands.join(shared, "key"), "buckets")
    several = sets.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    links = materialize(sets.join(several, "doc_id", "left_semi").join(classes, "digest").select(
        F.col("doc_id").alias("a"), F.col("member").alias("b")).filter("a <> b"), "links")
    parts = None if links.isEmpty() else connected_components(links)
    if not buckets.isEmpty():
        pairs = materialize(_star_pairs(buckets, sizes, percent), "pairs")
        links = links.union(materialize(confirmed(pairs, docs, width, percent), "links"))
        parts = connected_components(links)
        merged = buckets.join(parts.withColumnRenamed("node", "member"), "member", "left").select(
            "key", "member", F.coalesce("component", "member").alias("component"))
        still_open = merged.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")) \
            .filter("x <> y and n > 2").select("key")
        rest = materialize(merged.join(still_open, "key"), "open-buckets")
        more = materialize(_bucket_links(rest, least, docs, width, percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            parts = connected_components(links)
    to_class = classes.select("digest", "member")
    out = stored.join(to_class, "digest", "left")
    if parts is None:
        out = out.withColumn("component", F.col("member"))
    else:
        out = out.join(parts.withColumnRenamed("node", "member"), "member", "left")
    reached = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "member", "doc_id"))
    return out.select("doc_id", "n_shingles", reached.alias("component_id"))
