"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Documents are cut only where they are longer than a sequence. The number of pieces per
length, at most ``capacity`` rows whatever the corpus, goes to the driver, which runs
best-fit decreasing on counts: equal sequences are one group, and one step fills many of
them. The plan says for each length which ranks go where. Pieces then get their rank within
their length by a salted two-level numbering, look their slot up by rank, and no document
ever meets another one.

Null text counts as empty (its end id remains); repeated rows are pieces of their own; an
empty table gives an empty result; null ``doc_id`` is packed like any other.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallywing.llm.tokens import encode_texts, lean
from tallywing.session import materialize

CAPACITY = 4096


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = CAPACITY,
                 with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and on demand the piece's ids (32-bit little-endian)."""
    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs_of, piece, start, length, crc, raw = [], [], [], [], [], []
            names = batch["doc_id"].astype("Int64").tolist()
            for k, tokens in encode_texts(tokenizer, batch["text"].tolist(), end_id):
                for n, at in enumerate(range(0, len(tokens), capacity)):
                    data = tokens[at:at + capacity].astype("<u4").tobytes()
                    docs_of.append(names[k])
                    piece.append(n)
                    start.append(at)
                    length.append(len(data) // 4)
                    crc.append(zlib.crc32(data))
                    if with_ids:
                        raw.append(data)
            out = pd.DataFrame({"doc_id": pd.array(docs_of, "Int64"), "piece": piece, "start": start,
                                "length": length, "ids_crc32": crc})
            if with_ids:
                out["ids"] = pd.Series(raw, dtype=object)
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(lean(pieces), kind)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """Best-fit decreasing on counts per length, and the number of sequences.

    The result holds per length the runs (first rank, first sequence, pieces per sequence,
    offset) in order of rank. Every step splits at most one group of equal sequences, so
    there are a few groups per length at most.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    rests: list[int] = []
    sequences = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = {}

    def keep(rest: int, first: int, number: int) -> None:
        if rest and number:
            if rest not in groups:
                groups[rest] = []
                insort(rests, rest)
            groups[rest].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rests, length)
            if k < len(rests):
                rest = rests[k]
                first, number = groups[rest].pop()
                if not groups[rest]:
                    del groups[rest], rests[k]
            else:
                rest, first = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            each = rest // length
            full = min(number, left // each)
            if full:
                runs.setdefault(length, []).append((rank, first, each, capacity - rest))
                rank, left = rank + full * each, left - full * each
                keep(rest - each * length, first, full)
            if full < number:
                if left:
                    runs.setdefault(length, []).append((rank, first + full, each, capacity - rest))
                    keep(rest - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                keep(rest, first + full, number - full)
    return {length: np.asarray(r, np.int64) for length, r in runs.items()}, sequences


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank`` from 0 within each length without bringing a length into one task."""
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt")
    bases = sizes.select(F.col("length").alias("_length"), F.col("_salt").alias("_slot"),
                         (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    numbered = salted.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(bases, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_slot"))) \
        .withColumn("rank", F.col("_base") + F.col("_row")).drop("_salt", "_row", "_length", "_slot", "_base")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored ``pieces`` (doc_id, piece, start, length, ids_crc32, …).

    ``pieces`` is read three times, so pass a stored table. The collected histogram has at
    most ``capacity`` rows and the plan a few runs for each of them.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in
              pieces.filter("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan(counts, capacity)[0])
    columns = pieces.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                runs = slots.value[int(size)]
                run = runs[np.searchsorted(runs[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - run[:, 0]
                sequence[rows] = run[:, 1] + nth // run[:, 2]
                offset[rows] = run[:, 3] + nth % run[:, 2] * size
            yield batch[columns].assign(sequence_id=sequence, offset=offset)

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranked(pieces.filter("length > 0"), salts).mapInPandas(lean(place), kind)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int = CAPACITY,
                   with_ids: bool = False) -> DataFrame:
    """Encodes, stores and packs documents; one row per piece.

    Ids wait in the stored table and join their places by row number; no worker holds them
    while places are looked up."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity, with_ids)
    stored = materialize(pieces.withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    placed = pack(stored.drop("ids"), capacity)
    return (placed.join(stored.select("row_id", "ids"), "row_id") if with_ids else placed).drop("row_id")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of packed pieces with ``ids``: sequence_id, length, ids, doc_ids in order.

    A group is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("length")).select(
        "sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"),
        F.col("p.doc_id").alias("doc_ids"))
