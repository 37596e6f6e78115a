"""Repair of conversation structure: the cheapest edits that make turns alternate.

A repaired conversation has the roles ``(system? (user assistant)+)?``. Rows are kept (K, 0),
reroled to user or assistant (R, 2), deleted (D, 3), and empty turns are inserted anywhere
(I, 2); a truncated row that stays adds 1. Blank rows and repeats of an earlier row have to
go. The result per conversation is the least cost and, among the audits (the edits' letters
in order) of that cost, the least one in ASCII. An audit says which rows stay, and its length
without D says which role each place has, so it determines the repaired conversation.

The search is a depth-first branch and bound per conversation. Its nodes are (rows consumed,
last role). A suffix bound, the cost from a node on if the conversation might end after any
turn, prunes what cannot beat the incumbent; a table per node holds the least cost by which
it was reached and cuts worse prefixes. Branches are taken in ASCII order, so of two equally
dear prefixes of a node the first is the lesser audit, and a later solution has to be
strictly cheaper. The first incumbent follows the bound greedily. It can exceed the root's
bound by the closing inserts only (4 at most), so a node is expanded a handful of times and
the search is linear in the conversation.

The search reads one byte per row, not the texts. Texts are shuffled once, by conversation,
and stream past the audit in order; no conversation is held as a whole. A conversation is
one task's work, because its digest or its file needs its turns in sequence.

Roles count by their first character (s, u, a; any other, or none, cannot be kept). Null
roles and texts count as one blank, so such texts are blank rows. A null ``conv_id`` is a
conversation of its own, null turns come first, ties sort by role and the text's digest, and
repeated rows are duplicates. Further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 30
#: What the role initial of a row leads to from each state, if it may be kept there.
_KEPT = {"s": (_SYSTEM, None, None, None), "u": (_USER, _USER, None, _USER), "a": (None, None, _ASSISTANT, None),
         "-": (None, None, None, None)}


def _steps(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """Edits of a row in ASCII order: letter, rows consumed, next state, cost."""
    steps = [("D", 1, state, DELETE), ("I", 0, _NEXT[state], INSERT)]
    if code != "D":
        extra = TRUNCATED if code.isupper() or code == "=" else 0
        kept = _KEPT["-" if code == "=" else code.lower()][state]
        if kept is not None:
            steps.append(("K", 1, kept, KEEP + extra))
        steps.append(("R", 1, _NEXT[state], REROLE + extra))
    return steps


#: A row's code is its role initial (- if none of s, u, a), as a capital (= for -) if it is truncated, or D.
_EDITS = {code: [_steps(code, state) for state in range(4)] for code in "suaSUA-=D"}


def suffix_bounds(codes: str) -> array:
    """Per node (4 * rows consumed + state) a lower bound of the cost that follows."""
    bounds = array("q", bytes(32 * (len(codes) + 1)))
    for i in range(len(codes) - 1, -1, -1):
        edits, at = _EDITS[codes[i]], 4 * i
        for state in range(4):
            bounds[at + state] = min(cost + bounds[at + 4 + to] for _, rows, to, cost in edits[state] if rows)
        user, assistant = bounds[at + _USER], bounds[at + _ASSISTANT]
        bounds[at + _USER], bounds[at + _ASSISTANT] = min(user, assistant + INSERT), min(assistant, user + INSERT)
        for state in (_START, _SYSTEM):
            bounds[at + state] = min(bounds[at + state], bounds[at + _USER] + INSERT)
    return bounds


def _greedy(codes: str, bounds: array) -> tuple[int, str]:
    """A first repair: at each node the edit with the least cost and bound, then closing inserts."""
    i = state = total = 0
    audit: list[str] = []
    while i < len(codes):
        letter, rows, to, cost = min(_EDITS[codes[i]][state], key=lambda e: (e[3] + bounds[4 * (i + e[1]) + e[2]], e[0]))
        audit.append(letter)
        i, state, total = i + rows, to, total + cost
    while state not in (_START, _ASSISTANT):
        audit.append("I")
        state, total = _NEXT[state], total + INSERT
    return total, "".join(audit)


def cheapest_edits(codes: str) -> tuple[int, str]:
    """Least cost and the ASCII-least audit of that cost for a conversation's row codes."""
    n = len(codes)
    bounds = suffix_bounds(codes)
    best_cost, best = _greedy(codes, bounds)
    limit = best_cost + 1  # the first audit may be undercut in ASCII at the same cost
    reached = array("q", [_FAR]) * (4 * n + 4)
    path = bytearray()
    stack = [(0, _START, 0, 0, 0)]
    while stack:
        i, state, total, depth, letter = stack.pop()
        node = 4 * i + state
        if total >= reached[node] or total + bounds[node] >= limit:
            continue
        reached[node] = total
        if depth:
            del path[depth - 1:]
            path.append(letter)
        if i == n:
            if state in (_START, _ASSISTANT):
                best_cost, best, limit = total, path.decode("ascii"), total
            else:
                stack.append((i, _NEXT[state], total + INSERT, depth + 1, 73))
            continue
        for name, rows, to, cost in reversed(_EDITS[codes[i]][state]):
            stack.append((i + rows, to, total + cost, depth + 1, ord(name)))
    return best_cost, best


def _plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and the text's digest."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return rows.withColumn("digest", F.sha2("text", 256))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def row_codes(turns: DataFrame) -> DataFrame:
    """Per row without its text: conv_id, turn, place, fault (or null), initial, code.

    Rows of a conversation lie together and in order in one partition."""
    stem = F.rtrim(F.col("text"), F.lit(_BLANKS))
    ending = F.when(stem == "", "blank").when(~F.right(stem, F.lit(1)).isin(".", "!", "?"), "truncated")
    narrow = _plain(turns).select("conv_id", "turn", "role", "digest", ending.alias("ending"))
    whole = Window.partitionBy("conv_id")
    placed = narrow.withColumn("place", F.row_number().over(whole.orderBy(*_order())))
    first = F.min("place").over(Window.partitionBy("conv_id", "role", "digest"))
    fault = F.when(F.col("ending") == "blank", "blank").when(F.col("place") > first, "duplicate").otherwise(F.col("ending"))
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "D").when(
        F.col("fault") == "truncated", F.translate(known, "sua-", "SUA=")).otherwise(known)
    return placed.withColumn("fault", fault).withColumn("initial", known).withColumn("code", code) \
        .select("conv_id", "turn", "place", "fault", "initial", "code").sortWithinPartitions("conv_id", "place")


class _Tally:
    """What is known of a conversation while its rows pass."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.distinct = 0
        self.first = self.turn = None
        self.last = ""

    def add(self, turns: np.ndarray, known: np.ndarray, faults: list[str | None], initials: str, codes: str) -> None:
        for name in self.faults:
            self.faults[name] += faults.count(name)
        pairs = self.last + initials
        self.illegal += sum(pairs[k:k + 2] not in ("su", "ua", "au") for k in range(len(pairs) - 1))
        self.last = initials[-1]
        self.codes.append(codes)
        turns = turns[known]
        if len(turns):
            self.distinct += int((turns[1:] != turns[:-1]).sum()) + int(self.turn is None or turns[0] != self.turn)
            self.first = int(turns[0]) if self.first is None else self.first
            self.turn = int(turns[-1])

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.distinct
        return gaps, *self.faults.values(), self.illegal, *cheapest_edits("".join(self.codes))


_AUDIT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation: gaps in its turns, rows by first fault, illegal neighbours, cost, audit."""

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = None, None
        for batch in batches:
            if not len(batch):
                continue
            names = batch["conv_id"].astype("Int64")
            ids, missing = names.fillna(0).to_numpy(np.int64), names.isna().to_numpy()
            turn = batch["turn"].astype("Int64")
            turns_of, known = turn.fillna(0).to_numpy(np.int64), ~turn.isna().to_numpy()
            faults, initials, codes = batch["fault"].tolist(), "".join(batch["initial"]), "".join(batch["code"])
            heads = np.flatnonzero((np.diff(ids) != 0) | (np.diff(missing) != 0)) + 1
            done = []
            for start, end in zip([0, *heads], [*heads, len(batch)]):
                key = None if missing[start] else int(ids[start])
                if now is None or key != at:
                    if now is not None:
                        done.append((at, *now.row()))
                    now, at = _Tally(), key
                now.add(turns_of[start:end], known[start:end], faults[start:end], initials[start:end], codes[start:end])
            yield _frame(done)
        if now is not None:
            yield _frame([(at, *now.row())])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_AUDIT).astype({"conv_id": "Int64"})

    return row_codes(turns.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})).select(
        "conv_id", "turn", "fault", "initial", "code").mapInPandas(
        searched, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                  "cost bigint, audit string")


class _Editor:
    """Replays an audit over a conversation's rows."""

    def __init__(self, audit: str) -> None:
        self._audit, self._at, self._place = audit, 0, 0
        self._odd = (len(audit) - audit.count("D")) % 2

    def _due(self) -> str:
        return "assistant" if (self._place - self._odd) % 2 else "user"

    def inserts(self) -> Iterator[tuple[int, str, str]]:
        while self._at < len(self._audit) and self._audit[self._at] == "I":
            yield self._place, self._due(), "I"
            self._at, self._place = self._at + 1, self._place + 1

    def edit(self, role: str) -> tuple[int, str, str] | None:
        letter = self._audit[self._at]
        self._at += 1
        if letter == "D":
            return None
        self._place += 1
        at = self._place - 1
        return at, (role if letter == "K" else "assistant" if (at - self._odd) % 2 else "user"), letter


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns that remain: conv_id, place (from 0), turn (null if inserted), role, text, edit.

    ``found`` are the stored :func:`audits` of ``turns``. Turns of a conversation lie together and in order
    in one partition."""

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor, at, closing = None, None, None
        for batch in batches:
            out = []
            names = batch["conv_id"].astype("Int64").tolist()
            for key, kind, turn, role, text in zip(names, batch["kind"], batch["turn"].astype("Int64").tolist(),
                                                   batch["role"], batch["text"]):
                key = None if key is pd.NA else key
                if kind == 0:  # the audit comes before the rows
                    if editor is not None:
                        out += [(at, place, None, due, "", how) for place, due, how in editor.inserts()]
                    editor, at = _Editor(text), key
                    continue
                out += [(key, place, None, due, "", how) for place, due, how in editor.inserts()]
                kept = editor.edit(role)
                if kept:
                    out.append((key, kept[0], None if turn is pd.NA else turn, kept[1], text, kept[2]))
            yield _rows(out)
        if editor is not None:
            yield _rows([(at, place, None, due, "", how) for place, due, how in editor.inserts()])

    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", "place", "turn", "role", "text", "edit"]).astype(
            {"conv_id": "Int64", "turn": "Int64", "place": "int64"})

    rows = _plain(turns).select(F.col("conv_id").cast("long"), F.lit(1).alias("kind"), F.col("turn").cast("long"),
                                "role", "digest", "text")
    marks = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.lit("").alias("digest"), F.col("audit").alias("text"))
    dealt = rows.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    return dealt.select("conv_id", "kind", "turn", "role", "text").mapInPandas(
        replayed, "conv_id bigint, place bigint, turn bigint, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation with a turn left: conv_id, turns left, digest of ``role:text`` joined by newlines.

    Takes :func:`repaired_turns` as they come: in order, each conversation in one partition."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, n = None, None, 0
        for batch in batches:
            done = []
            for key, role, text in zip(batch["conv_id"].astype("Int64").tolist(), batch["role"], batch["text"]):
                key = None if key is pd.NA else key
                if now is None or key != at:
                    if now is not None:
                        done.append((at, n, now.hexdigest()))
                    now, at, n = hashlib.sha256(), key, 0
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
                n += 1
            yield _rows(done)
        if now is not None:
            yield _rows([(at, n, now.hexdigest())])

    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["conv_id", "n_left", "repaired_sha256"]).astype({"conv_id": "Int64", "n_left": "int64"})

    return repaired.select("conv_id", "role", "text").mapInPandas(hashed, "conv_id bigint, n_left bigint, repaired_sha256 string")
