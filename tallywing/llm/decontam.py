"""Benchmark decontamination: word n-grams as seeds, local alignment as the measure.

Every word n-gram of an item is a seed, and one hit is enough, so any copy that keeps three
words in a row is looked at. Where seeds occur in a document, Smith-Waterman alignment of the
item with the surrounding words scores the copy, edited or not: 1 per equal word, minus a
half per changed, added or missing one, divided by the item's words. Places that share too
few words with the item to reach the threshold are not aligned, which loses none. A copy
without three of the item's words in a row is not found, whatever its score.

The benchmark is sent to all tasks only if it has at most ``max_sent_words`` words; texts
are then read once and never shuffled. Larger benchmarks are joined on n-gram hashes.

Words are lower-cased and cut at white space and ASCII punctuation. Null and blank texts, and
items with fewer words than a seed, match nothing. A null ``doc_id`` or ``item_id`` is never
reported; rows with an equal id are one document, or one item with several texts, that keeps
its best score. Empty tables give an empty result, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallywing.llm.neardup import _STEP, mix, word_hashes
from tallywing.llm.tokens import lean, slices
from tallywing.session import materialize

SEED_WORDS = 3
THRESHOLD = 0.5
PENALTY = 0.5
MAX_SENT_WORDS = 2_000_000
_FILTER_BITS = 22
_BATCH_CHARS = 500_000
_FOUND = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint"

_BREAKS = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words_of(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    for part in slices(texts, _BATCH_CHARS):
        hashes, counts = word_hashes([(t or "").lower().encode("utf-8", "surrogatepass").translate(_BREAKS)
                                      for t in texts[part]])
        yield from np.split(hashes, np.cumsum(counts)[:-1])


def ngrams(words: np.ndarray, size: int) -> np.ndarray:
    joined = words
    for k in range(1, size):
        joined = mix(joined[:len(words) - k] * _STEP + words[k:]) if len(words) > k else joined[:0]
    return joined


class SeedIndex:
    """Looks n-gram hashes up in sorted seeds; a bit table turns most away at once."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self._maybe = np.zeros(1 << _FILTER_BITS, bool)
        self._maybe[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of place in ``grams`` and place among the seeds given."""
        at = np.flatnonzero(self._maybe[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, grams[at], "left")
        number = np.searchsorted(self.hashes, grams[at], "right") - low
        where = np.repeat(low - (np.cumsum(number) - number), number) + np.arange(number.sum())
        return np.repeat(at, number), self.order[where]


def stretches(at_doc: np.ndarray, at_item: np.ndarray, item_len: int, doc_len: int) -> list[tuple[int, int]]:
    """Stretches of a document in which the item may lie, from its seed hits.

    Hits that imply overlapping places are one stretch, cut at four times the item's length
    with an overlap that holds any copy whole."""
    slack = item_len // 2 + 2
    begins = np.sort(np.maximum(at_doc - at_item - slack, 0))
    out: list[tuple[int, int]] = []
    start, end = int(begins[0]), 0
    for begin in begins.tolist():
        if end and begin > end:
            out.append((start, end))
            start = begin
        end = begin + item_len + 2 * slack
    out.append((start, end))
    longest, step = 4 * item_len + 2 * slack, 2 * item_len
    return [(s, min(s + longest, e, doc_len)) for first, e in out for s in range(first, max(first + 1, e - (longest - step)), step)]


def align(item: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of an item with each word run: score, first and last word + 1.

    Rows of the recurrence are vectors over all runs; gaps along a row are a running maximum."""
    width = max(map(len, places))
    grid = np.zeros((len(places), width), np.uint64)
    valid = np.zeros((len(places), width), bool)
    for k, run in enumerate(places):
        grid[k, :len(run)], valid[k, :len(run)] = run, True
    columns = np.arange(width + 1)
    score = np.zeros((len(places), width + 1))
    origin = np.broadcast_to(columns, score.shape).copy()
    best, first, last = np.zeros(len(places)), np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    rows = np.arange(len(places))
    for word in item:
        gain = np.where((grid == word) & valid, 1.0, -PENALTY)
        step = np.zeros_like(score)
        came = np.broadcast_to(columns, score.shape).copy()
        diagonal, above = score[:, :-1] + gain, score[:, 1:] - PENALTY
        take = diagonal >= above
        value = np.where(take, diagonal, above)
        alive = value > 0
        step[:, 1:] = np.where(alive, value, 0)
        came[:, 1:] = np.where(alive, np.where(take, origin[:, :-1], origin[:, 1:]), columns[1:])
        lifted = step + PENALTY * columns
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted >= top, columns, 0), axis=1)
        along = top - PENALTY * columns
        score = np.maximum(along, 0)
        origin = np.where(along > 0, np.take_along_axis(came, source, 1), columns)
        here = np.where(valid, score[:, 1:], 0).argmax(axis=1) + 1
        peak = score[rows, here]
        better = peak > best
        best, first, last = np.where(better, peak, best), np.where(better, origin[rows, here], first), np.where(better, here, last)
    return best / len(item), first, last


def _may_reach(item: np.ndarray, places: list[np.ndarray], least: float) -> np.ndarray:
    """Whether each word run shares ``least`` words with the item, repeats counted; no score is higher."""
    known, number = np.unique(item, return_counts=True)
    words = np.concatenate(places)
    run = np.repeat(np.arange(len(places)), [len(p) for p in places])
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    same = known[at] == words
    shared = np.bincount(run[same] * len(known) + at[same], minlength=len(places) * len(known)).reshape(len(places), len(known))
    return np.minimum(shared, number).sum(axis=1) >= least - 1e-9


def _found_in(docs: list[tuple[int, np.ndarray]], items: list[np.ndarray], item_ids: np.ndarray,
              hits: dict[int, list[tuple[int, np.ndarray, np.ndarray]]], threshold: float) -> pd.DataFrame:
    """``hits``: per item the documents (place in ``docs``) with hit places in both."""
    out: list[tuple[int, int, float, int, int]] = []
    for item, of_item in hits.items():
        runs, owner = [], []
        for doc, at_doc, at_item in of_item:
            words = docs[doc][1]
            for s, e in stretches(at_doc, at_item, len(items[item]), len(words)):
                runs.append(words[s:e])
                owner.append((doc, s))
        for k in range(0, len(runs), 4096):
            may = k + np.flatnonzero(_may_reach(items[item], runs[k:k + 4096], threshold * len(items[item])))
            if not len(may):
                continue
            score, first, last = align(items[item], [runs[n] for n in may])
            for n in np.flatnonzero(score >= threshold):
                doc, s = owner[may[n]]
                out.append((docs[doc][0], int(item_ids[item]), float(score[n]), s + int(first[n]), s + int(last[n])))
    return pd.DataFrame(out, columns=["doc_id", "item_id", "score", "start_word", "end_word"])


def _gram_rows(frame: DataFrame, key: str) -> DataFrame:
    """key, pos, gram for every n-gram."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, words in zip(batch["k"], words_of(batch["text"].tolist())):
                grams = ngrams(words, SEED_WORDS)
                if len(grams):
                    yield pd.DataFrame({"k": name, "pos": np.arange(len(grams)), "gram": grams.view(np.int64)})
    return _keyed(frame, key).mapInPandas(lean(rows), "k bigint, pos bigint, gram bigint").withColumnRenamed("k", key)


def _keyed(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(F.col(key).cast("long").alias("k"), F.col("text").cast("string")).filter("k is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 max_sent_words: int = MAX_SENT_WORDS) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word of every copy at or over ``threshold``.

    One row per document and item: its best-scoring place, the first of equals."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(
        "item_id is not null and text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"[\s\p{Punct}]+")))).first()[0] or 0
    found = _by_sending(docs, items, threshold) if words <= max_sent_words else _by_joining(docs, items, threshold)
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _by_sending(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    rows = items.orderBy("item_id", "text").collect()
    item_ids = np.asarray([r["item_id"] for r in rows], np.int64)
    item_words = list(words_of([r["text"] for r in rows]))
    grams = [ngrams(w, SEED_WORDS) for w in item_words]
    of_docs = _keyed(docs, "doc_id")
    sent = spark.sparkContext.broadcast((
        np.concatenate([np.empty(0, np.uint64), *grams]), np.repeat(np.arange(len(grams)), [len(g) for g in grams]),
        np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)]), item_words, item_ids))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, item_of, pos_of, all_words, names = sent.value
        index = SeedIndex(gram)
        for batch in batches:
            docs_held: list[tuple[int, np.ndarray]] = []
            hits: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
            for name, words in zip(batch["k"].tolist(), words_of(batch["text"].tolist())):
                at, seed = index.find(ngrams(words, SEED_WORDS))
                if not len(at):
                    continue
                docs_held.append((name, words))
                by_item = np.argsort(item_of[seed], kind="stable")
                at, seed = at[by_item], seed[by_item]
                item, begin = np.unique(item_of[seed], return_index=True)
                for k, s, e in zip(item.tolist(), begin, [*begin[1:], len(seed)]):
                    hits.setdefault(k, []).append((len(docs_held) - 1, at[s:e], pos_of[seed[s:e]]))
            if hits:
                yield _found_in(docs_held, all_words, names, hits, threshold)

    return of_docs.mapInPandas(lean(scan), _FOUND)


def _by_joining(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The same for a benchmark of any size: n-grams meet in a shuffle join on their hash."""
    keyed = materialize(items.distinct().withColumn("item", F.xxhash64("item_id", "text")), "items")
    of_items = materialize(_gram_rows(keyed.select("item", "text"), "item"), "item-grams")
    hits = _gram_rows(docs, "doc_id").join(of_items.withColumnRenamed("pos", "item_pos"), "gram") \
        .groupBy("doc_id", "item").agg(F.collect_list("pos").alias("at_doc"), F.collect_list("item_pos").alias("at_item"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs_held = list(zip(batch["doc_id"].tolist(), words_of(batch["text"].tolist())))
            all_words = list(words_of(batch["item_text"].tolist()))
            hits = {k: [(k, np.asarray(a, np.int64), np.asarray(b, np.int64))]
                    for k, (a, b) in enumerate(zip(batch["at_doc"], batch["at_item"]))}
            yield _found_in(docs_held, all_words, batch["item_id"].to_numpy(), hits, threshold)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return hits.join(keyed.withColumnRenamed("text", "item_text"), "item").join(texts, "doc_id") \
        .select("doc_id", "text", "item_id", "item_text", "at_doc", "at_item").mapInPandas(lean(score), _FOUND)
