"""Token ids in fixed-width bit packing, written in document order and read at random.

A token table is a Parquet folder of blocks. Each block is one self-contained binary value:
a header (magic, bits per id, documents, ids), the documents' ids and token counts, and all
token ids packed at the least number of bits the vocabulary needs, least significant bit
first: id ``k`` of a block begins at bit ``k * bits``. The documents' counts give their
offsets, so any document or id range is unpacked by numpy without reading what lies before.
Parquet carries the blocks because its writer commits whole tasks on any shared store, so
lost executors leave no torn files, and its statistics let a reader skip blocks.

Null text counts as empty and leaves the end id alone; a null ``doc_id`` sorts first;
repeated rows are documents of their own. An id beyond the vocabulary is an error; ties sort by text; an empty table gives an empty
folder of blocks; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallywing.llm.tokens import encode_texts, lean

_HEADER = struct.Struct("<4sBxxxIQ")
_MAGIC = b"TWB1"
_NO_DOC = np.iinfo(np.int64).min
#: Ids of a block, and ids that are spread into bits at once.
BLOCK_IDS, SLICE = 1 << 18, 1 << 16
_BLOCK_TYPE = ("shard int, block int, first_doc bigint, last_doc bigint, ids_before bigint, "
               "n_docs int, n_ids bigint, data binary")


def bits_for(vocabulary: int) -> int:
    """Bits for ids 0 to ``vocabulary - 1``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` each; an id that needs more is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shifts = np.arange(bits, dtype=np.uint32)

    def packed(part: np.ndarray) -> bytes:
        one_by_one = (part.astype(np.uint32)[:, None] >> shifts) & 1
        return np.packbits(one_by_one.astype(np.uint8).ravel(), bitorder="little").tobytes()

    # A slice is a multiple of eight ids, so each ends at a whole byte.
    return b"".join(packed(ids[at:at + SLICE]) for at in range(0, len(ids), SLICE))


def unpack_bits(data: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a packed run."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(data, f"<u{width}", count, start * width).astype(np.uint32)
    out = np.empty(count, np.uint32)
    weights = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    for at in range(0, count, SLICE):
        begin, n = start + at, min(SLICE, count - at)
        first, last = begin * bits // 8, -(-(begin + n) * bits // 8)
        raw = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first), bitorder="little")
        skip = begin * bits - first * 8
        out[at:at + n] = raw[skip:skip + n * bits].reshape(n, bits).astype(np.uint32) @ weights
    return out


def make_block(docs: list[int], ids: list[np.ndarray], bits: int) -> bytes:
    counts = np.asarray([len(x) for x in ids], "<u8")
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    return b"".join([_HEADER.pack(_MAGIC, bits, len(docs), len(flat)),
                     np.asarray(docs, "<i8").tobytes(), counts.tobytes(), pack_bits(flat, bits)])


class Block:
    """A view of a block's bytes; nothing is unpacked until asked for."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, n, self.n_ids = _HEADER.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token block")
        at = _HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.counts = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        self.offsets = np.cumsum(self.counts) - self.counts
        self._payload = memoryview(data)[at + 16 * n:]

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        return unpack_bits(self._payload, self.bits, start, self.n_ids - start if count is None else count)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.counts[k]))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None,
                 vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
    """Encodes ``docs`` (doc_id, text) and writes blocks in ascending ``doc_id`` order.

    Texts are dealt into ``doc_id`` ranges before they are encoded, so ids are made once and
    never shuffled. A block is closed at ``block_ids`` ids; a longer document has its own.
    """
    bits = bits_for(vocabulary)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        names: list[int] = []
        parts: list[np.ndarray] = []
        number = before = held = 0

        def close() -> pd.DataFrame:
            bounds = [None if d == _NO_DOC else d for d in (names[0], names[-1])]
            return pd.DataFrame({"shard": [shard], "block": [number], "first_doc": [bounds[0]],
                                 "last_doc": [bounds[1]], "ids_before": [before], "n_docs": [len(names)],
                                 "n_ids": [held], "data": [make_block(names, parts, bits)]})

        for batch in batches:
            ids = batch["doc_id"].fillna(_NO_DOC).astype("int64").to_numpy()
            for k, tokens in encode_texts(tokenizer, batch["text"].tolist(), end_id):
                names.append(int(ids[k]))
                parts.append(tokens)
                held += len(tokens)
                if held >= block_ids:
                    yield close()
                    number, before, held, names, parts = number + 1, before + held, 0, [], []
        if names:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInPandas(lean(blocks), _BLOCK_TYPE).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned,
    over little-endian 32-bit ids), and on demand the ids themselves, all read from the blocks."""
    kind = "doc_id bigint, shard int, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, before, data in zip(batch["shard"], batch["ids_before"], batch["data"]):
                block = Block(data)
                flat = block.ids().astype("<u4")
                parts = np.split(flat, block.offsets[1:])
                out = pd.DataFrame({
                    "doc_id": pd.array([None if d == _NO_DOC else int(d) for d in block.doc_ids], "Int64"),
                    "shard": shard, "at": before + block.offsets, "n_tokens": block.counts,
                    "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts[:len(block.counts)]]})
                if with_ids:
                    out["ids"] = [p.astype(np.int32) for p in parts[:len(block.counts)]]
                yield out

    stored = spark.read.schema(_BLOCK_TYPE).parquet(path)
    # One row per shard, that is per write task.
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    decoded = stored.select("shard", "ids_before", "data").mapInPandas(lean(documents), kind)
    return decoded.join(starts, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
