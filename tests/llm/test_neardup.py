"""Components and near duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from tallywing.llm import neardup
from tallywing.llm.components import connected_components


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in root}


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 50)] \
        + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7), (None, 3), (5, None), (1, 0)]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == components(edges) and len(got) == len(components(edges))
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def expected(rows, width):
    sets = [(d, shingles(t, width)) for d, t in rows]
    edges = [(d, e) for k, (d, a) in enumerate(sets) for e, b in sets[k + 1:]
             if a and b and d is not None and e is not None and 100 * len(a & b) >= 80 * len(a | b)]
    parts = components(edges)
    return sorted(((d, len(s), parts.get(d, d)) for d, s in sets), key=repr)


def collection(width):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo\n"), (None, "one two"),
            (8, "naïve É"), (9, "naïve é"), (10, "a b"), (11, "a\xa0b")]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 90]))]
        for copy in range(rng.choice([1, 4, 12])):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((100 + 20 * family + copy, " ".join(words)))
    rows += [(400 + k, " ".join(["the same"] * 30 + [f"x{k % 3}"])) for k in range(40)]
    return rows + [rows[30], (130, rows[20][1])]


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(make_docs, width):
    rows = collection(width)
    got = neardup.link_components(make_docs(rows), width, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected(rows, width)


@pytest.mark.parametrize("large", [10, 1000])
def test_large_buckets_in_blocks(make_docs, monkeypatch, large):
    """Many members that are alike but mostly not linked, with buckets cut in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "LARGE", large)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(60), rng.choice([3, 7, 9])):
            words[at] = f"y{rng.randrange(1000)}"
        rows.append((k, " ".join(words)))
    got = neardup.link_components(make_docs(rows), 2, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected(rows, 2)


def test_empty(make_docs):
    assert neardup.link_components(make_docs([]), 2, 80).count() == 0
    only = neardup.link_components(make_docs([(1, None)]), 2, 80).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1)]


def test_sketch_agreement_follows_similarity():
    """Densified bins agree as often as the sets are similar, also for sets far smaller than the sketch."""
    sketcher = neardup.Sketcher()
    rng = np.random.default_rng(1)
    for size, common in ((500, 450), (20, 18), (6, 5)):
        agreed = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
            a, b = np.unique(pool[:size]), np.unique(pool[size - common:])
            agreed.append((sketcher.sketch(a) == sketcher.sketch(b)).mean())
        assert abs(np.mean(agreed) - common / (2 * size - common)) < 0.07
