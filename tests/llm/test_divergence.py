"""Divergence of sources against a dense plain version."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tallywing.llm import divergence

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, docs bigint, term string, copies string, digest string, base int"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_audit(rows, least_docs, top):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(lower(text or ""))
        counts[lang, source].update(words)
        in_docs[lang].update(set(words))
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = {t for t, n in in_docs[lang].items() if n >= least_docs}
        total = Counter()
        for s in names:
            total.update({t: n for t, n in counts[lang, s].items() if t in kept})

        def shares(c):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(total)
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in names if o != s]
            terms = [(-(p[s][t] - q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    words = ["Alpha", "beta", "BETA", "gamma9delta", "élan", "ÉLAN", "naïve", "x_y", "日本語", "𝒳𝒴", "don't", "a", "z" * 300]
    rows = []
    for k in range(260):
        lang = rng.choice(["en", "en", "de", "", None])
        source = rng.choice(["s1", "s2", "s3", "s3", "", None, "é", "quiet"])
        text = rng.choice([" ", "\n", "-"]).join(rng.choice(words[: 4 + (k % 10)]) for _ in range(rng.randrange(0, 14)))
        rows.append((lang, source, text))
    rows += [("en", "s1", "copied text Alpha beta")] * 40 + [("en", "s2", "copied text Alpha beta")] * 7
    rows += [("xx", "only", "nothing kept"), ("xx", "other", None), ("xx", None, ""), ("en", "no words", "123 _ \x7f"), ("en", "long", "beta " * 60_000)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(None if k % 7 == 0 else k % 5, text, lang, source, 1, 2, "t", "c", "d", 3)
                                  for k, (lang, source, text) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("tile, block", [(divergence.TILE, divergence.BLOCK), (2, 5)])
def test_equals_dense_version(spark, corpus, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    got = divergence.audit(table(spark, corpus).repartition(6), least_docs=12, top_terms=4)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(corpus, 12, 4)


def test_no_term_is_kept(spark, corpus):
    got = divergence.audit(table(spark, corpus), least_docs=10_000)
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(corpus, 10_000, 50)


def test_empty_table_and_single_source(spark):
    assert divergence.audit(table(spark, [])).collect() == []
    assert divergence.audit(table(spark, [("en", "s", "a b")]), least_docs=5).collect() == []


def test_copies_are_cut_once(spark, corpus):
    texts = divergence.distinct_texts(table(spark, corpus)).collect()
    assert len(texts) == len({(lang or "", text or "") for lang, _, text in corpus})
    (copied,) = [r for r in texts if r.text == "copied text Alpha beta"]
    assert {(c.source, c.n) for c in copied.copies} == {("s1", 40), ("s2", 7)}


def test_terms_of_bytes():
    texts = ["ab", "cd", "", "É1é", "\x80x", "-", "Z"]
    part = pa.array(["skipped", *texts]).slice(1)
    at, words = divergence.terms_of(part)
    assert list(zip(at.tolist(), words.to_pylist())) == [
        (k, w) for k, t in enumerate(texts) for w in TERM.findall(lower(t))]
    assert len(divergence.terms_of(pa.array([""], pa.string()))[0]) == 0
