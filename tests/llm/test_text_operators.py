"""Decontamination, quality, personal data and chat windows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.llm import chat, decontam, pii, quality

VOCABULARY = [f"{a}{b}" for a in ("ta", "ri", "mo", "ke", "lu", "so") for b in ("nel", "bar", "dis", "fon", "gas", "hut", "jor")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# Decontamination

def plain_alignment(item, doc):
    """Smith-Waterman cell by cell."""
    best = 0.0
    above = [0.0] * (len(doc) + 1)
    for a in item:
        row = [0.0]
        for k, b in enumerate(doc, 1):
            row.append(max(0.0, above[k - 1] + (1 if a == b else -0.5), above[k] - 0.5, row[k - 1] - 0.5))
        best, above = max(best, max(row)), row
    return best / len(item)


def test_alignment_equals_cell_by_cell():
    rng = random.Random(3)
    for _ in range(40):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 12))]
        runs = [[rng.randrange(6) for _ in range(rng.randrange(0, 25))] for _ in range(4)]
        score, first, last = decontam.align(np.asarray(item, np.uint64), [np.asarray(r, np.uint64) for r in runs])
        for s, f, e, run in zip(score, first, last, runs):
            assert s == pytest.approx(plain_alignment(item, run))
            if s:
                assert plain_alignment(item, run[f:e]) == pytest.approx(s)


@pytest.fixture(scope="module")
def leaks(spark, make_docs):
    rng = random.Random(5)
    items = [(k, prose(rng, 30)) for k in range(12)] + [(20, None), (21, ""), (22, "two words"), (None, prose(rng, 30)), (23, prose(rng, 3))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows, expected = [], set()
    for k, (item, text) in enumerate(items[:12]):
        words = text.split()
        edited = list(words)
        for at in range(2, 30, 7):
            edited[at] = "changed"
        moved = words[:10] + ["inserted", "here"] + words[10:20] + words[22:]
        for n, copy in enumerate((words, edited, moved, [w.upper() + "," for w in words])):
            rows.append((100 * k + n, f"{prose(rng, 50)} {' '.join(copy)} {prose(rng, 50)}"))
            expected.add((100 * k + n, item))
        rows.append((100 * k + 50, f"{prose(rng, 60)} {' '.join(words[:8])} {prose(rng, 60)}"))
    rows += [(5000 + k, prose(rng, 120)) for k in range(20)] + [(9000, None), (9001, ""), (None, items[0][1]), (9002, items[16][1])]
    expected.add((9002, 23))
    return make_docs(rows), benchmark, expected


@pytest.mark.parametrize("sent", [decontam.MAX_SENT_WORDS, 0])
def test_edited_copies_are_found(leaks, sent):
    docs, benchmark, expected = leaks
    got = decontam.contaminated(docs, benchmark, max_sent_words=sent).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    exact = next(r for r in got if r.doc_id == 100)
    assert exact.score == 1.0 and (exact.start_word, exact.end_word) == (50, 80)


@pytest.mark.parametrize("sent", [decontam.MAX_SENT_WORDS, 0])
def test_copies_with_every_fourth_word_replaced(spark, make_docs, sent):
    items, rows = [], []
    for n in range(12, 21):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        copy = ["other" if k % 4 == 3 else w for k, w in enumerate(words)]
        assert plain_alignment(words, copy) >= decontam.THRESHOLD
        rows.append((n, f"some text before {' '.join(copy)} and after"))
    # Another document has single words of them only.
    rows.append((99, " x ".join(t.split()[0] for _, t in items)))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contaminated(make_docs(rows), benchmark, max_sent_words=sent).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(n, n) for n in range(12, 21)}


def test_places_with_too_few_shared_words_only_are_left_out():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randrange(8) for _ in range(rng.randrange(3, 12))]
        runs = [[rng.randrange(12) for _ in range(rng.randrange(0, 25))] for _ in range(4)]
        may = decontam._may_reach(np.asarray(item, np.uint64), [np.asarray(r, np.uint64) for r in runs], 0.5 * len(item))
        assert all(m or plain_alignment(item, r) < 0.5 for m, r in zip(may, runs))


def test_no_items_or_documents(spark, make_docs, leaks):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contaminated(leaks[0], none).count() == 0
    assert decontam.contaminated(make_docs([]), leaks[1]).count() == 0


# Quality

def test_additive_model_learns_single_features_and_pairs():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality.FEATURES))).astype(np.float32)
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.95
    assert (0, 1) in model.pairs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    features = quality.features_table(docs)
    model = quality.learn(features, labels)
    kept = quality.learn_from(docs, labels)
    scored = features.select("doc_id", quality.held_out(F.col("doc_id")).alias("h"), quality.score_column(model, F.col("features")).alias("s"),
                             quality.score_column(kept, F.col("features")).alias("t")).join(labels, "doc_id").collect()
    assert all(r.s == pytest.approx(r.t) for r in scored)
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r.h]
    assert np.mean([(r.s >= quality.THRESHOLD) == (r.quality == 1) for r in held]) > 0.9


def test_quality_without_labels_or_texts(spark, make_docs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    features = quality.features_table(make_docs([(1, None), (1, ""), (None, " \n"), (2, "!" * 50_000)]))
    model = quality.learn(features, labels)
    got = features.select(quality.score_column(model, F.col("features")).alias("s")).collect()
    assert [r.s for r in got] == [0.5] * 4
    assert quality.features_table(make_docs([])).count() == 0


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checked(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_of(text):
    return sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(PATTERNS.items())
                  for m in re.finditer(p, text or "") if checked(k, m[0]))


HARD = ["mail a@b.c%d@e.f, a@b@c.d and x@y. or @z.q", "1.2.3.4.5.6.7.8 then 300.1.1.1 and 0001.02.003.255", "😀é +1 (168) 555-5254 é 10.0.0.1",
        "4111 1111 1111 1111, 4111111111111112 5500-0000-0000-0004", "+1 408 555 1234 129.38.82.176", "+12 (((((", "a." * 3000 + "@b.c.d",
        "9" * 5000, "1-" * 2000 + "1", "+" + "1 " * 500, "x@" + "y." * 3000 + "z", "", None, "@", "....", "a@b.c" * 50,
        "\n+1\n22", "1.2.3.4" * 10, "+1.2.3.4.5.6.7.8.9.0.1"]


def test_base_spans_equal_plain_matching(make_docs):
    rng = random.Random(8)
    rows = list(enumerate(HARD + ["".join(rng.choice("a1.@+- (0)é\n9") for _ in range(60)) for _ in range(300)]))
    docs = make_docs(rows).withColumn("text", F.coalesce("text", F.lit("")))
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.base_spans(docs).select("doc_id", "base").collect()}
    for d, text in rows:
        assert got[d] == base_of(text), text


def test_method_adds_spans_and_redacts(make_docs):
    rng = random.Random(6)
    number = lambda: "".join(str(rng.randrange(10)) for _ in range(4))
    rows = []
    for k in range(400):
        rows += [(4 * k, f"{prose(rng, 8)} +1 (408) 555-{number()} {prose(rng, 5)}"), (4 * k + 1, f"call me at n{k}@mail.example.org today"),
                 (4 * k + 2, f"token = \"{number()}af{number()}{number()}{number()}bc\" {number()}"), (4 * k + 3, prose(rng, 12))]
    docs = make_docs(rows + [(9000, None), (9001, ""), (None, "me@x.org"), (9002, "ring (408) 555-1234 now"), (9003, "go to n7(at)mail.example.org today")])
    model = pii.fit(docs)
    found = {r.doc_id: r for r in pii.all_spans(docs.withColumn("text", F.coalesce("text", F.lit(""))), model).collect()}
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in found.values())
    assert found[9002].spans and not found[9002].base
    assert not any(found[4 * k + 2].spans or found[4 * k + 3].spans for k in range(400))
    clean = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert clean[1].text == "call me at <EMAIL> today" and clean[1].n_chars == len(clean[1].text)
    assert clean[9000].text is None and clean[9001].text == "" and clean[None].text == "<EMAIL>" and clean[1].lang == "en"


def test_levels_come_from_all_documents(make_docs):
    rng = random.Random(7)
    rows = [(k, f"call +1 408 555 {1000 + k} {prose(rng, 4)} number 12.34.56.{k}.7") for k in range(60)]
    # Addresses occur only outside the sample; a card never does.
    order = [r.doc_id for r in make_docs(rows).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rare = set(order[40:])
    docs = make_docs([(k, f"write to n{k}@mail.example.org" if k in rare else t) for k, t in rows])
    model = pii.fit(docs, max_docs=40)
    assert {pii.KINDS[k] for k in model.least} == {"email", "phone"}
    assert docs.limit(1).select(model.least_of(F.lit(2)).alias("x")).first().x == pii.LEAST_SCORE


def runs_of(kind, match):
    """Runs of digit groups inside a match by plain loops: start, end."""
    few, many = pii.RUN_DIGITS[kind]
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", match)]
    return sorted((0 if i == 0 else groups[i][0], groups[j][1]) for i in range(len(groups)) for j in range(i, len(groups))
                  if few <= sum(e - s for s, e in groups[i:j + 1]) <= many and (i > 0 or j < len(groups) - 1))


def test_runs_inside_a_match_equal_plain_loops(spark):
    rng = random.Random(9)
    rows = ["4111 1111 1111 1111 123", "+1 408 555 1234 129.38.82.176", "+ (1) 22", "1 " * 700 + "1", "9" * 5000 + " 1234 567890 " + "9" * 30]
    rows += ["+(" * rng.randrange(2) + "".join(str(rng.randrange(10)) * rng.randrange(1, 6) + rng.choice(" .-(") * rng.randrange(1, 4)
                                              for _ in range(rng.randrange(1, 30))) + "7" for _ in range(100)]
    matches = spark.createDataFrame([(m,) for m in rows], "match string").select(F.struct(
        F.lit(5).cast("long").alias("start"), "match", F.lit("tel ").alias("left"), F.lit("").alias("right")).alias("x"))
    for r in matches.select("x.match", *(pii._runs(k, F.col("x")).alias(k) for k in pii.RUN_DIGITS)).collect():
        for kind in pii.RUN_DIGITS:
            assert sorted((s.start - 5, s.end - 5) for s in r[kind]) == runs_of(kind, r.match), r.match
            assert all(s.match == r.match[s.start - 5:s.end - 5] for s in r[kind])
            assert all(s.left == ("tel " + r.match[:s.start - 5])[-24:] for s in r[kind] if s.left and len(s.left) == 24)


def test_numbers_that_touch_another_number(make_docs):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        tail = "".join(str(rng.randrange(10)) for _ in range(4))
        card = "4111 1111 " + tail + " "
        last = next(n for n in range(1000, 1010) if checked("card", card + str(n)))
        rows += [(4 * k, f"call +1 408 555 {tail} {prose(rng, 5)}"), (4 * k + 1, f"card {card}{last} {prose(rng, 4)}"),
                 (4 * k + 2, f"card {card}{last + (k % 6 == 0)} {prose(rng, 4)}"), (4 * k + 3, f"host 10.0.{k % 256}.7 {prose(rng, 3)}")]
    texts = {9000: "card 4111 1111 1111 1111 123 and more", 9001: "call +1 408 555 1234 129.38.82.176 now"}
    docs = make_docs(rows + list(texts.items()))
    model = pii.fit(docs)
    found = {r.doc_id: r for r in pii.all_spans(docs, model).collect()}
    assert [tuple(s) for s in found[9000].base] == [] and (5, 2, 24) in [tuple(s) for s in found[9000].spans]
    assert [tuple(s) for s in found[9001].spans] == [(5, 3, 20), (21, 1, 34)]
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean[9001] == "call <PHONE> <IP> now" and "4111" not in clean[9000]
    # A card's number that fails its check stays.
    assert not any(s.kind == 2 for k in range(0, 300, 6) for s in found[4 * k + 2].spans)


def test_overlapping_spans_are_redacted_once(make_docs):
    docs = make_docs([(1, "é😀 +1 408 555 1234 129.38.82.176 x 10.0.0.1"), (2, "nothing")])
    got = {r.doc_id: r.text for r in pii.redact(docs, None).collect()}
    assert got == {1: "é😀 +1 408 555 1234 <IP> x <IP>", 2: "nothing"} or got[1].startswith("é😀 ")
    assert pii.fit(docs.limit(0)) is None and pii.redact(docs.limit(0), None).count() == 0


# Chat

PROBE = "</s>[INST] ok [/INST]"


def conversation_digests(rows):
    learnt = "".join(t or "" for _, r, t in rows if r == "assistant")
    told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    return len(rows), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_windows_read_back(spark):
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "\\", "<", "[", "\n", "<\\s>", "é😀", " word "]
    rows = [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE), (None, 0, "user", "no id"), (7, None, None, None), (7, 0, "assistant", "")]
    for conv in range(1, 6):
        rows.append((conv, 0, "system", f"rule {conv}"))
        rows += [(conv, t, ("user", "assistant", "to\\ol\nx")[t % 3], "".join(rng.choice(parts) for _ in range(rng.randrange(12))))
                 for t in range(1, 40)]
    rows += [(99, t, "assistant", "same") for t in (5, 5, 300, 600)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    windows = chat.format_conversations(turns, span=40, history=15)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role, text))
    for conv, of_conv in by_conv.items():
        r = got[conv]
        ordered = sorted(of_conv, key=lambda x: (x[0], x[1] or "", x[2] or ""))
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == conversation_digests(ordered), conv
    shown = windows.collect()
    assert sum(len(w.text) for w in shown) == sum(r.formatted_chars for r in got.values())
    first = {c: min(w.window for w in shown if w.conv_id == c) for c in by_conv}
    for w in shown:
        assert "</s>" not in w.text and "[INST]" not in w.text and "[/INST]" not in w.text
        if w.conv_id in range(1, 6):
            assert w.text.startswith("<|im_start|>system\nrule")
            assert (w.n_repeated == 0) == (w.window == first[w.conv_id])
    assert max(sum(1 for w in shown if w.conv_id == c) for c in range(1, 6)) > 3
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def plain_windows(turns, budget, history):
    """(own places, repeated places) of a conversation's windows; ``turns`` are (role, size) in order."""
    lead = turns[0][1] if turns[0][0] == "system" else 0
    body = list(range(1 if lead else 0, len(turns)))
    width, begin, cells = max(budget - history - lead, 1), 0, {}
    for k in body:
        cells.setdefault(begin // width, []).append(k)
        begin += turns[k][1]
    own = []
    for _, group in sorted(cells.items()):
        fits = len(group) == 1 or sum(turns[k][1] for k in group) <= width
        own += [group] if fits else [group[:-1], group[-1:]]
    out = []
    for n, group in enumerate(own):
        room, again = min(history, budget - lead - sum(turns[k][1] for k in group)), []
        for k in reversed(own[n - 1] if n else []):
            room -= turns[k][1]
            if room < 0:
                break
            again.insert(0, k)
        out.append((group, again))
    return out


@pytest.mark.parametrize("budget,history", [(60, 20), (40, 0), (100, 50)])
def test_windows_keep_to_the_budget(spark, budget, history):
    rng = random.Random(budget)
    rows, sizes = [], {}
    for conv in range(30):
        lead = {0: 0, 1: 8, 2: budget - 10, 3: budget + 20}[conv % 4]
        turns = [("system", lead)] * bool(lead) + [
            (("user", "assistant")[k % 2], rng.choice((4, 7, 9, 15, 30, budget, 2 * budget))) for k in range(rng.randrange(1, 60))]
        sizes[conv] = turns
        rows += [(conv, t, role, f"{conv}.{t}", size - chat.TURN_TOKENS) for t, (role, size) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, counted bigint")
    got = chat.format_conversations(frame, budget, history, tokens=F.col("counted")).collect()
    for conv, turns in sizes.items():
        windows = sorted((w for w in got if w.conv_id == conv), key=lambda w: w.window)
        lead = turns[0][1] if turns[0][0] == "system" else 0
        wanted = plain_windows(turns, budget, history)
        assert len(windows) == len(wanted)
        for n, (w, (own, again)) in enumerate(zip(windows, wanted)):
            shown = [int(x.split(".")[1]) for x in re.findall(r"\d+\.\d+", w.text)]
            assert shown == [0] * bool(lead) + again + own
            assert w.n_repeated == len(again) + (lead > 0 and n > 0)
            assert w.n_tokens == sum(turns[k][1] for k in shown)
            assert w.n_tokens <= budget or (len(own) == 1 and not again)
