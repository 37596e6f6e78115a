"""Fingerprints against a plain version over neighbouring documents."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallywing.llm import fingerprints
from tallywing.llm.fingerprints import Fingerprint

DOCS = "doc_id bigint, text string, bucket int, place bigint, is_next boolean, b string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0D]+", lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def prose(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    rows = [(k * 3, prose(rng, rng.choice([1, 3, 40, 200, 800]))) for k in range(120)]
    same = prose(rng, 300)
    rows += [(1000, same), (1001, same.upper()), (1002, same), (1003, ""), (1004, None), (1005, "one two"), (1006, "one TWO"),
             (1007, "Ünï cödé 日本 " * 40), (1008, prose(rng, 60_000)), (5, "tie one"), (5, "tie two"), (5, "tie two"),
             (None, "no id " + prose(rng, 50)), (None, "no id either"), (-7, "before zero")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 4, 5, True, "x") for i, t in rows], DOCS)


def ordered(spark, rows):
    from pyspark.sql import functions as F

    hashes = {r.text: r.h for r in frame(spark, rows).select(
        F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    return sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1]))


def test_equals_plain_version(spark, rows):
    got = fingerprints.follow_up(frame(spark, rows).repartition(7)).collect()
    inline = ordered(spark, rows)
    wanted = []
    for k, (i, text) in enumerate(inline):
        following = inline[(k + 1) % len(inline)][1]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        wanted.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), text, changed, following))
    assert sorted([(r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got]) == sorted(
        [(i is not None, i or 0, n, h) for i, n, h, *_ in wanted])
    expected, wrong = [], []
    for i, _, digest, text, changed, following in wanted:
        own, mark, after = (Fingerprint.parse(str(x)) for x in fingerprints.fingerprints([text, changed, following]))
        expected.append((i or 0, digest, str(own), str(mark), own.likeness(mark), own.likeness(after), own.contained_in(mark)))
        a, b = shingles(text), shingles(changed)
        assert own.shingles == len(a)
        if len(a) > 150:
            wrong.append(abs(own.likeness(mark) - len(a & b) / len(a | b)))
    assert sorted((r.doc_id or 0, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next,
                   r.contained_in_edited) for r in got) == sorted(expected)
    assert np.mean(wrong) < 0.06


def test_equal_texts_and_short_ones():
    one, upper, other, none, empty = fingerprints.fingerprints(["a b c", "A B C", "a b d", None, ""])
    assert str(one) == str(upper) and one.likeness(upper) == 1.0
    assert str(one) != str(other) and one.likeness(other) == 0.0
    assert str(none) == str(empty) and none.shingles == 0 and none.likeness(one) == 0.0


def test_sketches_merge_and_contain():
    rng = random.Random(32)
    parts = [prose(rng, 3_000) for _ in range(6)]
    alone = fingerprints.fingerprints(parts)
    whole = fingerprints.fingerprints([" ".join(parts)])[0]
    union = fingerprints.merged(alone)
    # The whole has the parts' shingles and four more at each seam.
    assert len(np.setdiff1d(union, whole.hashes)) == 0 and len(whole.hashes) - len(union) <= 20
    assert alone[2].contained_in(whole) == 1.0 and whole.contained_in(alone[2]) == pytest.approx(1 / 6, abs=0.03)
    assert len(alone[0].hashes) == pytest.approx(3_000 / fingerprints.FRACTION, rel=0.15)


@pytest.mark.parametrize("only", [[], [(3, "a single document of some words")], [(None, None)]])
def test_tiny_tables(spark, only):
    got = fingerprints.follow_up(frame(spark, only)).collect()
    assert len(got) == len(only)
    for r in got:  # a single document follows itself
        assert r.near_next == 1.0
