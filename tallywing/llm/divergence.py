"""Divergence of sources: how differently the sources of a language use its terms.

Identical texts of a language are one row with its multiplicity per source, so each text is
cut into terms once however often it was copied; counts and document frequencies are then
added with those weights. Texts are shuffled once. Tasks fold their terms per (language,
term, source) before the second shuffle, by (language, term), in which a term's counts and
its document frequency come together.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps
the terms in at least ``least_docs`` of its documents (rows). With ``count`` occurrences of a
term, ``N`` of all kept terms and ``V`` kept terms, the share of a term in a source or a
language is ``1 + floor(10^9 * (count + 5) / (N + 5 V))``, in decimals of 38 digits.

The distance of two sources is the sum of differences over all kept terms. It is evaluated
sparsely: a term that neither has adds the difference of their base shares, so only terms
that occur are looked at. Entries are dealt by blocks of terms and pairs of source tiles;
a task adds up the differences of its block for all pairs of its sources and emits one row
per pair, never one per term and pair.

Null text, language and source count as ''. Null ``doc_id`` and repeated rows are documents
like others; further columns are ignored; a source without terms has base shares only; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywing.session import materialize

LEAST_DOCS, TOP_TERMS = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
TILE, BLOCK = 256, 500_000
_CHUNK_BYTES = 6_000_000
_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()),
                     ("n", pa.int64()), ("docs", pa.int64())])


def _lower_or_zero() -> np.ndarray:
    """Bytes of terms, A-Z lower-cased; 0 for any other byte."""
    table = np.zeros(256, np.uint8)
    table[0x61:0x7B] = table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


_LOWER = _lower_or_zero()


def terms_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Text number of every term, and the terms, cut from the texts' UTF-8 bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    size = int(offsets[-1] - offsets[0])
    data = texts.buffers()[2]
    low = _LOWER[np.frombuffer(data, np.uint8, size, int(offsets[0]))] if size else np.empty(0, np.uint8)
    borders = offsets - offsets[0]
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = borders[(borders > 0) & (borders < size)]
    begins[cuts] |= inside[cuts]
    ends[cuts - 1] |= inside[cuts - 1]
    starts, lengths = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lengths = lengths - starts
    text_of = np.searchsorted(borders, starts, "right") - 1
    word_offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(word_offsets), pa.py_buffer(low[inside]))
    return text_of, words.dictionary_encode()


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sum of each value per key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    heads = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[heads], *[np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values]


def _weighted_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents per (lang, term, source) of distinct texts with multiplicities."""
    text_of, words = terms_of(batch["text"])
    codes = words.indices.to_numpy().astype(np.int64)
    n_words = max(len(words.dictionary), 1)
    cells, uses = _summed(text_of * n_words + codes, np.ones(len(codes), np.int64))
    text, word = cells // n_words, cells % n_words
    firsts, sizes = np.searchsorted(text, np.arange(len(batch))), np.bincount(text, minlength=len(batch))
    # Each (text, source) takes the text's terms with the source's multiplicity.
    copies = batch["copies"]
    owner = pc.list_parent_indices(copies).to_numpy()
    flat = pc.list_flatten(copies)
    source = flat.field("source").dictionary_encode()
    times = flat.field("n").to_numpy()
    lang = batch["lang"].dictionary_encode()
    taken = sizes[owner]
    at = np.repeat(firsts[owner] - (np.cumsum(taken) - taken), taken) + np.arange(int(taken.sum()))
    weight = np.repeat(times, taken)
    n_sources = max(len(source.dictionary), 1)
    lang_of = np.repeat(lang.indices.to_numpy().astype(np.int64)[owner], taken)
    source_of = np.repeat(source.indices.to_numpy().astype(np.int64), taken)
    keys, n, docs = _summed((lang_of * n_words + word[at]) * n_sources + source_of, weight * uses[at], weight)
    pair, source_at = keys // n_sources, keys % n_sources
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(pair // n_words)), words.dictionary.take(pa.array(pair % n_words)),
         source.dictionary.take(pa.array(source_at)), pa.array(n), pa.array(docs)], schema=_COUNTS)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)) // _CHUNK_BYTES
        heads = np.flatnonzero(np.diff(sizes, prepend=-1)) if len(sizes) else []
        for start, end in zip(heads, [*heads[1:], len(batch)]):
            yield _weighted_counts(batch.slice(int(start), int(end - start)))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """lang, text, copies (source, n) per distinct text of a language."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]) \
        .withColumn("digest", F.sha2("text", 256))
    per_source = named.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n"))
    copies = per_source.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = named.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, uses (source, n) of the terms in at least ``least_docs`` documents of a language."""
    counted = distinct_texts(docs).mapInArrow(
        _count_terms, "lang string, term string, source string, n bigint, docs bigint")
    # Dealt by term, so that a term's sources and its document frequency meet without another shuffle.
    per_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return per_source.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("in_docs"), F.collect_list(F.struct("source", "n")).alias("uses")
    ).filter(F.col("in_docs") >= least_docs).select("lang", "term", "total", "uses")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)); null without terms."""
    def exact(value: Column) -> Column:
        return value.cast("decimal(20,0)")

    part = (exact(count) + F.lit(PRIOR)) * F.lit(SCALE)
    whole = exact(total) + F.lit(PRIOR) * exact(terms)
    return F.when(terms > 0, 1 + F.call_function("div", part, whole))


def _pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Differences of one block of terms, for all pairs of sources of two tiles.

    Rows without a term list the sources with their base share and, in the first block, the number of terms
    of the language. A pair's sum is terms * |base a - base b|, plus for each term what its share moves that."""
    is_source = rows["term_id"].isna().to_numpy()
    listed = rows[is_source].sort_values("source")
    names, base, tile = listed["source"].to_numpy(), listed["base"].to_numpy(np.int64), listed["tile"].to_numpy(np.int64)
    number = len(names)
    out = np.abs(base[:, None] - base[None, :]) * int(listed["n_terms"].iloc[0])
    entries = rows[~is_source].sort_values("term_id", kind="stable")
    place = np.searchsorted(names, entries["source"].to_numpy()) if len(entries) else np.empty(0, np.int64)
    term, value = entries["term_id"].to_numpy(np.int64), entries["share"].to_numpy(np.int64)
    # A term of a alone: |share - base b| instead of |base a - base b|, by prefix sums over a's sorted shares.
    for a in np.unique(place):
        own = np.sort(value[place == a])
        before = np.concatenate([[0], np.cumsum(own)])
        under = np.searchsorted(own, base)
        moved = (base * under - before[under]) + (before[-1] - before[under] - base * (len(own) - under))
        moved -= len(own) * np.abs(base[a] - base)
        out[a] += moved
        out[:, a] += moved
    # A term of both: |share a - share b| instead of the two moves; k-th neighbours within a term at a time.
    step = 1
    while step < len(term):
        both = np.flatnonzero(term[step:] == term[:-step])
        if not len(both):
            break
        a, b = place[both], place[both + step]
        x, y = value[both], value[both + step]
        more = np.abs(x - y) - np.abs(x - base[b]) - np.abs(base[a] - y) + np.abs(base[a] - base[b])
        sums = np.zeros(number * number, np.int64)
        np.add.at(sums, a * number + b, more)
        sums = sums.reshape(number, number)
        out += sums + sums.T
        step += 1
    first, second = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
    a, b = np.nonzero((tile[:, None] == first) & (tile[None, :] == second))
    fit = (a < b) if first == second else np.ones(len(a), bool)
    a, b = a[fit], b[fit]
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "a": names[a], "b": names[b], "value": out[a, b]})


def pair_distances(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value, for every ordered pair.

    ``entries``: lang, term_id, source, share; ``groups``: lang, source, base, n_terms for every source."""
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    loads = entries.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    dealing = materialize(tiles.join(loads, "lang", "left").select(
        "lang", "tiles", F.ceil(F.coalesce("n", F.lit(0)) / F.col("tiles") / BLOCK).cast("int").alias("some"))
        .select("lang", "tiles", F.greatest("some", F.lit(1)).alias("blocks")), "dealing")
    other = F.sequence(F.lit(0), F.col("tiles") - 1)
    pair = F.explode(F.transform(other, lambda j: F.struct(F.least("tile", j).alias("x"), F.greatest("tile", j).alias("y"))))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    listed = groups.join(dealing, "lang").select(
        "lang", "source", tile, "tiles", F.col("base").alias("base"), "n_terms",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")) \
        .select("lang", "block", "source", "tile", "base", F.when(F.col("block") == 0, F.col("n_terms")).otherwise(0).alias("n_terms"),
                F.lit(None).cast("long").alias("term_id"), F.lit(None).cast("long").alias("share"), pair.alias("p"))
    dealt = entries.join(dealing, "lang").select(
        "lang", F.pmod(F.xxhash64("term_id"), F.col("blocks")).cast("int").alias("block"), "source", tile, "tiles", "term_id", "share") \
        .select("lang", "block", "source", "tile", F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("n_terms"),
                "term_id", "share", pair.alias("p"))
    rows = listed.unionByName(dealt).select("*", "p.x", "p.y").drop("p")
    unit = ("lang", "block", "x", "y")
    # Dealt by unit even where the joins have left a language's rows together.
    sums = rows.repartition(*unit).groupBy(*unit).applyInPandas(
        _pair_sums, "lang string, a string, b string, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("p"), "value").select("lang", "p.source", "p.item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources of the language (``pair``, all of
    them) and the terms that a source uses more than its language (``term``, the first ``top_terms``)."""
    kept = materialize(kept_terms(docs, least_docs).withColumn("term_id", F.monotonically_increasing_id()), "terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("in_lang"))
    uses = kept.select("lang", "term_id", "term", "total", F.inline("uses"))
    per_source = uses.groupBy("lang", "source").agg(F.sum("n").alias("in_source"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = materialize(
        named.join(langs, "lang", "left").join(per_source, ["lang", "source"], "left").select(
            "lang", "source", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("in_lang", F.lit(0)).alias("in_lang"),
            F.coalesce("in_source", F.lit(0)).alias("in_source"))
        .withColumn("base", F.coalesce(share(F.lit(0), F.col("in_source"), F.col("n_terms")), F.lit(0))), "sources")
    shared = uses.join(groups, ["lang", "source"]).select(
        "lang", "source", "term_id", "term", share(F.col("n"), F.col("in_source"), F.col("n_terms")).alias("share"),
        share(F.col("total"), F.col("in_lang"), F.col("n_terms")).alias("lang_share"))
    pairs = pair_distances(shared.select("lang", "term_id", "source", "share"), groups.select("lang", "source", "base", "n_terms"))
    above = shared.filter("share > lang_share").select(
        "lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked_pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place)
    ranked_terms = above.select("lang", "source", F.lit("term").alias("part"), "item", "value", place).filter(F.col("rank") <= top_terms)
    return ranked_pairs.unionByName(ranked_terms)
