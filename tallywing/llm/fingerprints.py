"""Document fingerprints by threshold-scaled sketches of word shingles.

A fingerprint keeps every distinct hash of a document's five-word shingles that lies below a
fixed fraction of the hash range. So the sketch of a union of documents is the union of their
sketches, and a sketch of a long document can be compared with one of a short document: the
retained hashes of the one are an even sample of its shingles whatever the size of the other.
Resemblance and containment are estimated from the retained hashes alone.

A fingerprint's text is ``shingles:digest:hashes``: the number of distinct shingles, a digest
of the whole set, and the retained hashes in ascending order, six bytes each in base 64. Equal
texts have equal fingerprints, and documents too short to retain a hash are still told apart.

Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than five words
has its whole sequence as one shingle, one without words none. Null text counts as empty.
Documents come in order of ``doc_id`` (null first); rows with an equal one are documents of
their own, ordered by a hash of the text, then the text; the document after the last is the
first, so a single one follows itself. An empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywing.llm.neardup import shingle_sets

WIDTH = 5
#: One shingle in so many is retained.
FRACTION = 4
_BITS = 48


class Fingerprint:
    """A sketch: retained hashes in ascending order, the number of shingles, and the set's digest."""

    def __init__(self, hashes: np.ndarray, shingles: int, digest: str) -> None:
        self.hashes, self.shingles, self.digest = hashes, shingles, digest

    @classmethod
    def of(cls, shingles: np.ndarray, fraction: int = FRACTION) -> Fingerprint:
        """From sorted distinct 64-bit hashes of which the upper 48 bits are kept."""
        limit = np.uint64(((1 << _BITS) // fraction) << (64 - _BITS))
        low = shingles[:np.searchsorted(shingles, limit)] >> np.uint64(64 - _BITS)
        return cls(np.unique(low), len(shingles), hashlib.blake2b(shingles.tobytes(), digest_size=8).hexdigest())

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        shingles, digest, coded = text.split(":")
        raw = np.frombuffer(base64.b64decode(coded), np.uint8).reshape(-1, _BITS // 8)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 8 - _BITS // 8:] = raw
        return cls(wide.view(">u8").ravel().astype(np.uint64), int(shingles), digest)

    def __str__(self) -> str:
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BITS // 8:]
        return f"{self.shingles}:{self.digest}:{base64.b64encode(raw.tobytes()).decode('ascii')}"

    def _common(self, other: Fingerprint) -> int:
        return len(np.intersect1d(self.hashes, other.hashes, assume_unique=True))

    def likeness(self, other: Fingerprint) -> float:
        """Estimated resemblance; 1 for equal sets, 0 if neither retains a hash."""
        if self.digest == other.digest:
            return 1.0
        common = self._common(other)
        union = len(self.hashes) + len(other.hashes) - common
        return common / union if union else 0.0

    def contained_in(self, other: Fingerprint) -> float:
        """Estimated share of the shingles that ``other`` has too."""
        if self.digest == other.digest:
            return 1.0
        return self._common(other) / len(self.hashes) if len(self.hashes) else 0.0


def merged(parts: list[Fingerprint]) -> np.ndarray:
    """Retained hashes of the union of documents."""
    return np.unique(np.concatenate([p.hashes for p in parts])) if parts else np.empty(0, np.uint64)


def fingerprints(texts: list[str | None], width: int = WIDTH, fraction: int = FRACTION) -> list[Fingerprint]:
    return [Fingerprint.of(s, fraction) for s in shingle_sets(texts, width)]


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first code points of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_first(), F.col("place")]


#: Ranges per shuffle partition; several even out what hashing deals to a task.
_RANGES = 2


def _cuts(docs: DataFrame) -> list[tuple[bool, int, int]]:
    """The least (has an id, doc_id, place) of each range of the table: a row or less per partition."""
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "place")).alias("first")
    parts = _RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.select("doc_id", "place").repartitionByRange(parts, *_order()).groupBy(
        F.spark_partition_id().alias("part")).agg(first)
    return sorted((r.first.known, r.first.doc_id or 0, r.first.place) for r in ranges.collect())


def in_ranges(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of (doc_id, place), each range with the first row of the next at its end.

    Takes doc_id, place, text; returns bucket, is_next, doc_id, place, text. The ranges begin at rows of the
    table, so a row's own key tells whether the range before needs it too; after the last range comes the first."""
    cuts = _cuts(docs)

    @F.pandas_udf("bucket int, is_cut boolean")
    def bucket_of(doc_id: pd.Series, place: pd.Series) -> pd.DataFrame:
        keys = list(zip((~doc_id.isna()).tolist(), doc_id.fillna(0).astype("int64").tolist(), place.tolist()))
        buckets = [bisect_right(cuts, key) - 1 for key in keys]
        return pd.DataFrame({"bucket": buckets, "is_cut": [cuts[b] == key for b, key in zip(buckets, keys)]})

    placed = docs.withColumn("b", bucket_of("doc_id", "place"))
    before = F.pmod(F.col("b.bucket") - 1, F.lit(max(len(cuts), 1)))
    own = F.struct(F.col("b.bucket").alias("bucket"), F.lit(False).alias("is_next"))
    tail = F.struct(before.alias("bucket"), F.lit(True).alias("is_next"))
    dealt = placed.select("doc_id", "place", "text", F.explode(
        F.when(F.col("b.is_cut"), F.array(own, tail)).otherwise(F.array(own))).alias("d"))
    return dealt.select("d.bucket", "d.is_next", "doc_id", "place", "text")


_RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, contained_in_edited double, contained_in_next double")


def follow_up(docs: DataFrame, width: int = WIDTH, fraction: int = FRACTION) -> DataFrame:
    """Per document (doc_id, text): its fingerprint, that of its edited text, and how alike it is to the edited
    text and to the next document. Texts are shuffled once, into ranges of ``doc_id``."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # bucket, doc_id, text, fingerprint; waits for the next row of its bucket
        for batch in batches:
            texts = batch["text"].tolist()
            marks = fingerprints(texts, width, fraction)
            pairs = []
            for row in zip(batch["bucket"], batch["is_next"], batch["doc_id"].astype("Int64"), texts, marks):
                if held is not None and held[0] == row[0]:
                    pairs.append((held, row))
                # The row after the bucket's end closes it; copies of it add nothing.
                held = None if row[1] else row
            changed = [edited(one[3], two[3]) for one, two in pairs]
            out = []
            for (one, two), text, mark in zip(pairs, changed, fingerprints(changed, width, fraction)):
                own = one[4]
                out.append((one[2], len(one[3]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                            str(own), str(mark), own.likeness(mark), own.likeness(two[4]),
                            own.contained_in(mark), own.contained_in(two[4])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("place", F.xxhash64("text"))
    dealt = in_ranges(rows).repartition("bucket").sortWithinPartitions("bucket", "is_next", *_order(), "text")
    return dealt.select("bucket", "is_next", "doc_id", "text").mapInPandas(compared, _RESULT)
