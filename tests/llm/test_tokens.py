"""Encoding, bit packing and sequence packing against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywing.llm import bitpack, packing, tokens
from tallywing.session import work_dir

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["a\tb  c \n\n d<|endoftext|> x", "", None, "  ", "é ́x\n", "it's  Σ Σας 12 345 !!\n", "a  b",
       "\n\n", "don't 'll x", "one", " one", "one\ntwo", "one \ntwo", "x y", "zero​width", "a\x00b", "<|startoftext|>",
       "word " * 5000, "ab" * 20000]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path):
    got = [list(ids) for _, ids in tokens.encode_texts(path, ODD, None)]
    assert got == library(path, ODD)
    assert [ids[-1] for _, ids in tokens.encode_texts(path, ODD, 7)] == [7] * len(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé Σß\n\t 'st1.!<|>́中"), max_size=30), max_size=6))
def test_any_text(texts):
    for path in (BYTE, WORD):
        assert [list(ids) for _, ids in tokens.encode_texts(path, texts, None)] == library(path, texts)


def test_memory_is_thinned_out(monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBERED", 50)
    encoder = tokens.WordEncoder(BYTE)
    for k in range(6):
        texts = [" ".join(f"w{(k * 37 + j) % 211}" for j in range(90)), "w1 w2 w3"]
        flat, sizes = encoder.encode(texts)
        assert list(flat) == sum(library(BYTE, texts), []) and len(sizes) == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=70), st.data())
def test_bits_round_trip(bits, values, data):
    ids = np.asarray([v % (1 << bits) for v in values], np.uint32)
    packed = bitpack.pack_bits(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    start = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - start))
    assert list(bitpack.unpack_bits(packed, bits, start, count)) == list(ids[start:start + count])


@pytest.mark.parametrize("bits", [1, 7, 13, 17, 31])
def test_packing_in_slices(monkeypatch, bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    whole = bitpack.pack_bits(ids, bits)
    monkeypatch.setattr(bitpack, "SLICE", 64)
    assert bitpack.pack_bits(ids, bits) == whole
    for start, count in ((0, 1003), (5, 900), (63, 130), (1000, 3), (1003, 0)):
        assert list(bitpack.unpack_bits(whole, bits, start, count)) == list(ids[start:start + count])
    for width in (bits, 8, 16):
        with pytest.raises(ValueError):
            bitpack.pack_bits(np.asarray([1 << width], np.uint32), width)


def test_vocabulary_that_is_no_whole_bytes(spark, make_docs):
    """17 bits an id; a vocabulary too small for the ids is refused."""
    path = work_dir(spark, "blocks")
    rows = [(k, f"text {k} with words") for k in range(30)]
    bitpack.write_tokens(make_docs(rows), path, BYTE, 2, 100_000, block_ids=40)
    assert bitpack.Block(bytes(spark.read.parquet(path).first()["data"])).bits == 17
    got = bitpack.read_tokens(spark, path, with_ids=True).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [ids + [2] for ids in library(BYTE, [t for _, t in rows])]
    with pytest.raises(Exception, match="does not fit"):
        bitpack.write_tokens(make_docs(rows), work_dir(spark, "blocks"), BYTE, 2, 16)


def test_token_blocks(spark, make_docs):
    rows = [(k * 7 % 101, f"text {k} with words") for k in range(101)] + [(500, None), (501, ""), (None, "no id"), (3, "again")]
    path = work_dir(spark, "blocks")
    bitpack.write_tokens(make_docs(rows), path, BYTE, 2, 50_257, block_ids=40)
    got = bitpack.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    expected = [ids + [2] for ids in library(BYTE, [t for _, t in order])]
    starts = np.cumsum([0, *map(len, expected)])
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(d, s, len(e)) for (d, _), s, e in zip(order, starts, expected)]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.asarray(e, "<u4").tobytes()) for e in expected]
    assert [list(r.ids) for r in got] == expected
    block = bitpack.Block(bytes(spark.read.parquet(path).first()["data"]))
    assert list(block.document(1)) == list(block.ids(int(block.offsets[1]), int(block.counts[1])))


def test_token_blocks_of_nothing(spark, make_docs):
    path = work_dir(spark, "blocks")
    bitpack.write_tokens(make_docs([]), path, BYTE, 2, 50_257)
    assert bitpack.read_tokens(spark, path).count() == 0


def best_fit(lengths, capacity):
    """Piece by piece: the fullest sequence that has room."""
    rests = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rests) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rests[k])
            rests[k] -= n
        else:
            rests.append(capacity - n)
    return len(rests)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    runs, number = packing.plan(counts, 40)
    assert number == best_fit(lengths, 40)
    used = np.zeros((number, 40), int)
    for length, of_length in runs.items():
        ends = [*of_length[1:, 0], counts[length]]
        for (first, sequence, each, offset), end in zip(of_length, ends):
            for k in range(end - first):
                at = offset + k % each * length
                used[sequence + k // each, at:at + length] += 1
    assert used.sum() == sum(lengths) and used.max(initial=0) <= 1
    assert all((np.diff(row) <= 0).all() for row in used)


def test_packing(spark, make_docs):
    rows = [(k, "word " * (k % 23)) for k in range(200)] + [(900, None), (901, "long " * 300), (7, "word"), (None, "x")]
    packed = packing.pack_documents(make_docs(rows), WORD, 1, capacity=64, with_ids=True)
    pieces = packed.collect()
    expected = {(d, len(ids)): ids for (d, _), ids in zip(rows, [i + [1] for i in library(WORD, [t for _, t in rows])])}
    assert sum(p.length for p in pieces) == sum(len(i) + 1 for i in library(WORD, [t for _, t in rows]))
    long = sorted((p for p in pieces if p.doc_id == 901), key=lambda p: p.piece)
    assert b"".join(bytes(p.ids) for p in long) == np.asarray(expected[901, 301], "<u4").tobytes()
    assert [p.start for p in long] == [64 * k for k in range(5)]
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
    whole = packing.sequences(packed).collect()
    assert all(len(s.ids) == 4 * s.length and s.length <= 64 for s in whole)
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert ends.filter("n <> e").count() == 0
    assert packing.pack_documents(make_docs([]), WORD, 1).count() == 0
