"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature is binned. Cyclic boosting visits one feature after another and adds a tree of
three leaves over that feature's bins, at a small rate, to the feature's lookup table; pairs
of features that explain what is left get tables of their own, from trees that cut either
feature twice. A text's score is the sum of one table entry per feature and per pair.

The model is fitted on the driver with at most ``max_rows`` labelled rows, those with the
least hash of their ``doc_id``; features of all texts are made and scored in Spark.

Null and blank texts have zero features and a score like any other; rows with an equal
``doc_id`` are scored each, and a document's label is the mean of its labels, 1 from a half
up. Null labels are ignored. Without labels every score is 0.5, with labels of one kind only
it is near that kind. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywing.llm.neardup import word_hashes
from tallywing.llm.tokens import lean, slices

FEATURES = ("log_words", "mean_word", "longest_word", "upper", "digits", "sentence_marks", "noise_marks",
            "exclamations", "bars", "other_marks", "beyond_ascii", "repeated_next", "distinct_words",
            "words_per_line", "distinct_lines", "tripled_marks")
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
_BATCH_CHARS = 500_000


def _classes() -> np.ndarray:
    """A one-hot row of character classes for every byte."""
    sets = {"upper": range(65, 91), "digits": range(48, 58), "sentence_marks": map(ord, ".,;:?'\"()-"),
            "noise_marks": map(ord, "#%$&*"), "exclamations": b"!", "bars": b"|",
            "other_marks": map(ord, "+/<=>@[\\]^_`{}~"), "beyond_ascii": range(128, 256)}
    table = np.zeros((256, len(sets)))
    for k, members in enumerate(sets.values()):
        table[list(members), k] = 1
    return table


_CLASSES = _classes()


def features_of(texts: list[str | None]) -> np.ndarray:
    """One row of features per text, over the whole text."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for part in slices(texts, _BATCH_CHARS):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[part]]
        hashes, counts = word_hashes(raw)
        end = 0
        for k, (data, n) in enumerate(zip(raw, counts), part.start):
            start, end = end, end + int(n)
            if not n:
                continue
            words = hashes[start:end]
            codes = np.frombuffer(data, np.uint8)
            visible = max(1, int((codes > 32).sum()))
            shares = np.bincount(codes, minlength=256) @ _CLASSES / visible
            lines = [x for x in data.split(b"\n") if x.strip()]
            longest = max(map(len, data.split()))
            same = codes[1:] == codes[:-1]
            tripled = (same[1:] & same[:-1] & (_CLASSES[codes[2:], 3] > 0)).sum() / visible
            out[k] = (np.log1p(n), visible / n, min(longest, 1000), *shares,
                      (words[1:] == words[:-1]).sum() / n, len(np.unique(words)) / n,
                      n / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), tripled)
    return out


def feature_column(text: Column) -> Column:
    """The features of a text column as an array."""
    def rows(batch: pd.Series) -> pd.Series:
        return pd.Series(list(features_of(batch.tolist())), dtype=object)
    return F.pandas_udf(rows, "array<float>")(text.cast("string"))


@dataclass
class Additive:
    """Cuts per feature, tables per feature and per pair of coarser bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(values) else np.empty(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _leaf_table(g: np.ndarray, h: np.ndarray, rate: float, least: float) -> np.ndarray:
    """A tree with up to three leaves over the bins of one feature."""
    borders = [0, len(g)]
    for _ in range(2):
        best, cut = 1e-9, None
        for s, e in zip(borders, borders[1:]):
            cg, ch = np.cumsum(g[s:e]), np.cumsum(h[s:e])
            if e - s < 2:
                continue
            left_g, left_h, all_g, all_h = cg[:-1], ch[:-1], cg[-1], ch[-1]
            gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, cut = gain[k], s + k + 1
        if cut is None:
            break
        borders = sorted([*borders, cut])
    out = np.zeros(len(g))
    for s, e in zip(borders, borders[1:]):
        out[s:e] = -rate * g[s:e].sum() / (h[s:e].sum() + 1.0)
    return out


def _cell_table(g: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
    """A tree over a grid: the best cut of one feature, then the best cut of the other in each half."""
    best, chosen = -1.0, None
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            value, leaves = 0.0, []
            for rows in (slice(0, cut), slice(cut, None)):
                cg, ch = np.cumsum(a[rows].sum(0)), np.cumsum(b[rows].sum(0))
                gains = _gain(cg, ch) + _gain(cg[-1] - cg, ch[-1] - ch)
                k = int(gains.argmax())
                value += gains[k]
                leaves.append((rows, k + 1))
            if value > best:
                best, chosen = value, (turned, leaves)
    out = np.zeros_like(g)
    if chosen is None:
        return out
    view, a, b = (out.T, g.T, h.T) if chosen[0] else (out, g, h)
    for rows, k in chosen[1]:
        for columns in (slice(0, k), slice(k, None)):
            view[rows, columns] = -rate * a[rows, columns].sum() / (b[rows, columns].sum() + 1.0)
    return out


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, margin) - y * margin)) if len(y) else 0.0


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.08, bins: int = 48, coarse_bins: int = 8,
        pairs: int = 10, patience: int = 30) -> Additive:
    """Boosts single features, then pairs, each as long as every fifth row's loss falls."""
    positive = (y.sum() + 0.5) / (len(y) + 1)
    cuts = [_quantile_cuts(x[:, k], bins) for k in range(x.shape[1])] if len(y) else [np.empty(0)] * len(FEATURES)
    coarse = [_quantile_cuts(c, coarse_bins) if len(c) else c for c in cuts]
    model = Additive(float(np.log(positive / (1 - positive))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse)
    if len(np.unique(y)) < 2:
        return model
    checked = np.arange(len(y)) % 5 == 4
    at = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    grid = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]
    margin = np.full(len(y), model.base)
    learn = ~checked

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return np.where(learn, p - y, 0), np.where(learn, p * (1 - p), 0)

    def boost(visit, tables: list[np.ndarray]) -> None:
        nonlocal margin
        best, kept, since = _loss(margin[checked], y[checked]), ([t.copy() for t in tables], margin.copy()), 0
        for _ in range(rounds):
            visit()
            loss = _loss(margin[checked], y[checked])
            since = since + 1
            if loss < best - 1e-6:
                best, kept, since = loss, ([t.copy() for t in tables], margin.copy()), 0
            if since >= patience:
                break
        tables[:], margin = kept

    def singles() -> None:
        nonlocal margin
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = _leaf_table(np.bincount(at[k], g, len(table)), np.bincount(at[k], h, len(table)), rate, 2.0)
            table += step
            margin = margin + step[at[k]]

    boost(singles, model.tables)

    def cells(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(grid[a] * shape[1] + grid[b], weights, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    strength = {(a, b): float(_gain(cells(a, b, g), cells(a, b, h)).sum()) for a, b in combinations(range(x.shape[1]), 2)
                if len(coarse[a]) and len(coarse[b])}
    model.pairs = sorted(strength, key=lambda p: (-strength[p], p))[:pairs]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]

    def doubles() -> None:
        nonlocal margin
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = _cell_table(cells(a, b, g), cells(a, b, h), rate)
            table += step
            margin = margin + step[grid[a], grid[b]]

    boost(doubles, model.pair_tables)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(features: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Additive:
    """Fits on ``features`` (doc_id, features) that have a label and are not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double")).filter(
        "quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = features.filter(~held_out(F.col("doc_id"))).join(known, "doc_id") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("features")).limit(max_rows).select("features", "y").collect()
    x = np.asarray([r["features"] for r in rows], np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, np.asarray([r["y"] for r in rows], float))


def learn_from(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Additive:
    """Fits on at most ``max_rows`` labelled documents and makes features of those only."""
    chosen = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")) \
        .filter(~held_out(F.col("doc_id"))).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows numbers.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return learn(features_table(texts), labels, max_rows)


def score_column(model: Additive, features: Column) -> Column:
    def rows(batch: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.asarray(batch.tolist(), np.float32).reshape(len(batch), len(FEATURES))))
    return F.pandas_udf(rows, "double")(features)


def features_table(docs: DataFrame) -> DataFrame:
    """doc_id and features of every text."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "features": pd.Series(list(features_of(batch["text"].tolist())), dtype=object)})
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(
        lean(rows), "doc_id bigint, features array<float>")
