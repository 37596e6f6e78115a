"""Conversations as training windows within a budget of tokens, with a loss mask.

Prefix sums of turn tokens deal a conversation's turns into cells as wide as the budget less the
system turn and the history. The turns that begin in a cell make one window; where the last of
them ends so far beyond the cell that they do not fit together, it gets a window of its own. So
no turn is cut. A window repeats the conversation's system turn and the last turns of the window
before, as far as they fit the history's share and the budget; repeated turns and all that the
assistant did not write are masked. Every assistant text is thus learnt from once.

A window exceeds the budget only if the system turn and its only own turn do; it then has no
history. Tokens are counted by ``turn_tokens``, words and single marks, unless a column with the
tokens of a turn's text is given; the budget holds for that measure.

A turn is written ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line
break. Where a text holds a control string, a backslash is put behind its first character;
one that stands there already is joined by another, so reading back takes one away.

Null text and null roles count as empty. Turns are ordered by ``turn`` (null first), then
role and text; repeated rows are turns of their own. A null ``conv_id`` is a conversation
like any other. An empty table gives no window; further columns are ignored.

Only DataFrame functions are used. Prefix sums are made in two levels, so a conversation with
a third of all turns is no single task there. ``read_back`` needs a conversation's text in one
row, because a digest over a text runs from its first character to its last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN_TOKENS, HISTORY_TOKENS, TURN_TOKENS = 1024, 256, 4
_START, _END = "<|im_start|>", "<|im_end|>"
_CLOSE = _END + "\n"
_CHUNK = 256

#: What follows the first character of each control string.
_TAILS = r"(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAILS}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_TAILS}", "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Words and single marks, plus what the template adds."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + TURN_TOKENS


def _numbered(turns: DataFrame, tokens: Column | None) -> DataFrame:
    """conv_id, place (from 1), begin (tokens before), size, total and lead (tokens of the conversation
    and of its system turn), role, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = turn_tokens(text) if tokens is None else \
        F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0)) + TURN_TOKENS
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        text.alias("text"), given.cast("long").alias("size")) \
        .withColumn("chunk", F.coalesce(F.floor(F.col("turn") / _CHUNK), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.withColumn("place", F.count("*").over(inside)).withColumn("begin", F.sum("size").over(inside) - F.col("size"))
    first = F.min_by(F.struct("role", "size"), F.struct("turn", "role", "text"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("s"), first.alias("first"))
    along = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening = F.first("first").over(along)
    bases = chunks.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"),
                          (F.sum("n").over(along) - F.col("n")).alias("_n"), (F.sum("s").over(along) - F.col("s")).alias("_s"),
                          F.sum("s").over(Window.partitionBy("conv_id")).alias("total"),
                          F.when(opening["role"] == "system", opening["size"]).otherwise(0).alias("lead"))
    return near.join(bases, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))).select(
        "conv_id", (F.col("place") + F.col("_n")).alias("place"), (F.col("begin") + F.col("_s")).alias("begin"),
        "size", "total", "lead", "role", "text")


def _in_windows(turns: DataFrame, budget: int, history: int, tokens: Column | None) -> DataFrame:
    """Every turn in each window that shows it: conv_id, window, place, own (not repeated), size, role, text."""
    width = F.greatest(F.lit(budget - history) - F.col("lead"), F.lit(1))
    rows = _numbered(turns, tokens).withColumn("system", (F.col("place") == 1) & (F.col("role") == "system")) \
        .withColumn("width", width) \
        .withColumn("cell", F.when(F.col("system"), 0).otherwise(F.floor((F.col("begin") - F.col("lead")) / F.col("width"))))
    # A turn has a token at least, so a cell holds no more turns than its width and one.
    cell = Window.partitionBy("conv_id", "cell")
    in_cell = F.when(~F.col("system"), F.col("size"))
    splits = (F.sum(in_cell).over(cell) > F.col("width")) & (F.count(in_cell).over(cell) > 1)
    rows = rows.withColumn("splits", F.coalesce(splits, F.lit(False))).withColumn("top", F.max("begin").over(cell)) \
        .withColumn("last", F.col("begin") == F.col("top")).withColumn("cell_end", F.max(F.col("begin") + F.col("size")).over(cell))
    before_last = F.col("splits") & ~F.col("last")
    rows = rows.withColumn("window", 2 * F.col("cell") + (F.col("splits") & F.col("last")).cast("long")) \
        .withColumn("end", F.when(before_last, F.col("top")).otherwise(F.col("cell_end"))) \
        .withColumn("next", F.when(before_last, F.col("window") + 1).otherwise(
            2 * F.floor((F.col("end") - F.col("lead")) / F.col("width")))) \
        .withColumn("back", F.col("end") - F.col("begin"))
    shown = F.array(F.struct(F.col("window").alias("window"), F.lit(True).alias("own")))
    again = F.array(F.struct(F.col("next").alias("window"), F.lit(False).alias("own")))
    near = (F.col("end") < F.col("total")) & (F.col("back") <= history) & ~F.col("system")
    # The system turn names all later windows that exist.
    others = rows.filter("window > 0").select(F.col("conv_id").alias("_conv"), F.col("window").alias("_window")).distinct()
    told = ["conv_id", "window", "place", "own", "size", "lead", "back", "role", "text"]
    kept = rows.filter("system").join(others, F.col("conv_id").eqNullSafe(F.col("_conv"))) \
        .withColumn("window", F.col("_window")).withColumn("own", F.lit(False)).withColumn("back", F.lit(0).cast("long")).select(told)
    own = rows.withColumn("w", F.explode(F.when(near, F.concat(shown, again)).otherwise(shown))) \
        .withColumn("window", F.col("w.window")).withColumn("own", F.col("w.own")) \
        .withColumn("back", F.when(~F.col("own") & ~F.col("system"), F.col("back")).otherwise(0)).select(told)
    # History gives way to an own turn that is wider than a cell.
    mine = F.sum(F.when(F.col("own") & ((F.col("place") > 1) | (F.col("lead") == 0)), F.col("size")).otherwise(0)).over(
        Window.partitionBy("conv_id", "window"))
    return own.unionByName(kept).withColumn("mine", mine).filter(
        (F.col("back") == 0) | (F.col("lead") + F.col("back") + F.col("mine") <= budget)).drop("mine", "lead", "back")


def format_conversations(turns: DataFrame, span: int = SPAN_TOKENS, history: int = HISTORY_TOKENS,
                         tokens: Column | None = None) -> DataFrame:
    """conv_id, window, text, n_tokens, n_repeated, loss_spans (start and length in code points of ``text``).

    ``span`` is the budget of a window, ``history`` the share of it for repeated turns; ``tokens``
    are the tokens of a turn's text (null or negative: none), to which those of the template are added."""
    parts = _in_windows(turns, span, history, tokens).select(
        "conv_id", "window", "place", "own", "size", F.concat(F.lit(_START), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"), (F.col("own") & (F.col("role") == "assistant")).alias("learn"))
    gathered = parts.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("place", "own", "head", "body", "learn"))).alias("t"), F.sum("size").alias("n_tokens"))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.char_length(turn["head"])
        length = F.char_length(turn["body"])
        span_here = F.array(F.struct(begin.alias("start"), length.alias("length")))
        return F.struct((begin + length + F.lit(len(_CLOSE))).alias("at"),
                        F.when(turn["learn"], F.concat(state["spans"], span_here)).otherwise(state["spans"]).alias("spans"))

    return gathered.select(
        "conv_id", "window",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(_CLOSE))), "").alias("text"),
        "n_tokens", F.size(F.filter("t", lambda x: ~x["own"])).alias("n_repeated"),
        F.aggregate("t", empty, step, lambda s: s["spans"]).alias("loss_spans"))


def parsed(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the window's own turns), learnt (texts under the mask)."""
    bodies = F.slice(F.split("text", r"<\|im_start\|>", -1), F.col("n_repeated") + 2, F.size(F.split("text", r"<\|im_start\|>", -1)))
    plain = F.transform(bodies, lambda x: F.split(x, r"<\|im_end\|>", -1)[0])

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"),
                        unescape(F.substr(x, F.char_length(role) + 2)).alias("text"))

    learnt = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(plain, turn).alias("turns"), learnt.alias("learnt"),
                          F.char_length("text").cast("long").alias("chars"))


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted windows alone."""
    told = parsed(windows).select(
        "conv_id", "window", "chars", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("told"),
        F.array_join("learnt", "").alias("learnt"))
    whole = told.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "told", "learnt"))).alias("w"),
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    all_told, all_learnt = (F.array_join(F.col(f"w.{c}"), "") for c in ("told", "learnt"))
    return whole.select("conv_id", "n_turns", F.sha2(all_told, 256).alias("turns_sha256"),
                        F.char_length(all_learnt).cast("long").alias("loss_chars"), F.sha2(all_learnt, 256).alias("loss_sha256"),
                        "formatted_chars")
