"""Repair of conversations against an exhaustive search, and its handling of odd rows."""

import hashlib
import heapq
import random
import re

import pytest

from tallywing.llm import repair

TURNS = "conv_id bigint, turn bigint, role string, text string, place bigint, code string, kind int, digest string"
BLANK = " \t\n\x0b\x0c\r"


def plain_codes(rows):
    seen, codes = set(), []
    for role, text in rows:
        stem = text.rstrip(BLANK)
        if not stem or (role, text) in seen:
            codes.append("D")
        else:
            initial = role[:1] if role[:1] in tuple("sua") else "-"
            codes.append(initial if stem[-1] in ".!?" else {"-": "="}.get(initial, initial.upper()))
        seen.add((role, text))
    return "".join(codes)


def plain_search(codes):
    """All edit sequences in order of (cost, audit) until one gives legal roles."""
    queue = [(0, "", 0, "")]
    while True:
        cost, audit, i, roles = heapq.heappop(queue)
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        for due in "ua":
            if not roles.endswith(due):
                heapq.heappush(queue, (cost + 2, audit + "I", i, roles + due))
        if i == len(codes):
            continue
        code = codes[i]
        heapq.heappush(queue, (cost + 3, audit + "D", i + 1, roles))
        if code != "D":
            extra = int(code in "SUA=")
            if code.lower() in "sua" and re.fullmatch("s?(ua)*u?|", roles + code.lower()):
                heapq.heappush(queue, (cost + extra, audit + "K", i + 1, roles + code.lower()))
            for due in "ua":
                if re.fullmatch("s?(ua)*u?|", roles + due):
                    heapq.heappush(queue, (cost + 2 + extra, audit + "R", i + 1, roles + due))


def plain_repair(rows, audit):
    left, i = [], 0
    n = len(audit) - audit.count("D")
    due = (["system"] if n % 2 else []) + ["user", "assistant"] * (n // 2)
    for letter in audit:
        if letter == "I":
            left.append((due[len(left)], ""))
            continue
        role, text = rows[i]
        i += 1
        if letter == "K":
            left.append((role, text))
        elif letter == "R":
            left.append((due[len(left)], text))
    return left


def test_search_equals_exhaustive_search():
    rng = random.Random(11)
    cases = ["", "s", "S", "u", "a", "D", "-", "=", "sD", "ss", "as", "aa", "uu", "AU", "sus", "DDD", "sau", "usa"]
    cases += ["".join(rng.choice("suaSUA-=Duauaua") for _ in range(rng.randrange(1, 7))) for _ in range(150)]
    for codes in cases:
        assert repair.cheapest_edits(codes) == plain_search(codes), codes


def test_search_is_linear_and_bounded_on_long_conversations():
    rng = random.Random(12)
    codes = "s" + "".join(rng.choice("uauauaUADs") for _ in range(20_000))
    cost, audit = repair.cheapest_edits(codes)
    bounds = repair.suffix_bounds(codes)
    assert bounds[0] <= cost <= bounds[0] + 4
    assert len(audit) - audit.count("I") == len(codes)
    assert repair.cheapest_edits("a" * 5_000) == (5_000, "RK" * 2_500)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(13)
    texts = ["Yes.", "No", "", "  ", "Well?\n", "Ah!", "long " * 50_000 + "end."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "ursula", ""]
    given = {c: [(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randrange(1, 7))] for c in range(40)}
    given[100] = [(None, "user", "First."), (3, None, "x."), (7, "assistant", None), (7, "assistant", "Two?"), (7, "assistant", "Two?")]
    given[None] = [(0, "assistant", "Null conversation.")]
    given[101] = [(None, "user", "a."), (None, "assistant", "b.")]
    given[102] = [(0, "user", "Hi."), (10**12, "assistant", "Ho.")]
    return given


def test_tables_equal_plain_repair(spark, conversations):
    rows = [(c, t, r, x, 9, "D", 5, "z") for c, turns in conversations.items() for t, r, x in turns]
    random.Random(14).shuffle(rows)
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    found = {r.conv_id: r for r in repair.audits(turns).collect()}
    frame = repair.audits(turns)
    left = repair.repaired_turns(turns, frame)
    digests = {r.conv_id: r for r in repair.digests(left).collect()}
    kept = {}
    for r in left.collect():
        kept.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    assert set(found) == set(conversations)
    for c, turns_of in conversations.items():
        ordered = sorted([(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns_of],
                         key=lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.sha256(z[2].encode()).hexdigest()))
        plain = [(r, x) for _, r, x in ordered]
        codes = plain_codes(plain)
        cost, audit = plain_search(codes)
        assert (found[c].cost, found[c].audit) == (cost, audit)
        wanted = plain_repair(plain, audit)
        assert [(role, text) for _, role, text in sorted(kept.get(c, []))] == wanted
        known = [t for t, _, _ in ordered if t is not None]
        assert found[c].gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert found[c].blank == sum(not x.strip(BLANK) for _, x in plain)
        assert found[c].blank + found[c].duplicate == codes.count("D")
        assert found[c].truncated == sum(k in "SUA=" for k in codes)
        pairs = [(a[:1] if a[:1] in tuple("sua") else "-") + (b[:1] if b[:1] in tuple("sua") else "-")
                 for (a, _), (b, _) in zip(plain, plain[1:])]
        assert found[c].illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        if wanted:
            assert digests[c].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in wanted).encode()).hexdigest()
            assert digests[c].n_left == len(wanted)
        else:
            assert c not in digests


def test_one_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", None, None, None, None) for t in range(4_000) if t % 100]
        turns = spark.createDataFrame(rows, TURNS)
        (found,) = repair.audits(turns).collect()
        left = repair.repaired_turns(turns, repair.audits(turns))
        (digest,) = repair.digests(left).collect()
        roles = [r.role for r in sorted(left.collect(), key=lambda r: r.place)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.gaps == 39 and found.illegal == 39
    assert roles == ["user", "assistant"] * (len(roles) // 2) and digest.n_left == len(roles)


def test_empty_table(spark):
    turns = spark.createDataFrame([], TURNS)
    assert repair.audits(turns).collect() == []
    assert repair.digests(repair.repaired_turns(turns, repair.audits(turns))).collect() == []
