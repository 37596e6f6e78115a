"""Log envelopes: parse, route into typed tables, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywing.functions.coerce import as_flag, as_float, as_whole
from tallywing.functions.timeparts import utc_timestamp
from tallywing.model import CORRUPT, ENVELOPE, EVENT_KINDS, MESSAGE, UNKNOWN_KIND, Warehouse
from tallywing.operators.common import stack
from tallywing.session import materialize, work_dir

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files under ``path`` as ``value``; large plain files are split by Spark."""
    return spark.read.text(path)


def _parse(rows: DataFrame, text: str, schema: T.StructType, output: str) -> DataFrame:
    """Add ``output``, the object in column ``text`` or null where that is not one whole object.

    The parser is the input of a generator. As a plain projection it would be copied into
    every filter and field access above it, and each copy would parse the text again.
    """
    guarded = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    found = F.from_json(text, guarded, {"columnNameOfCorruptRecord": CORRUPT})
    parsed = rows.select("*", F.explode_outer(F.array(found)).alias("_found"))
    bare = F.trim(F.col(text), F.lit(" \t\r\n"))
    whole = F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}"))
    good = whole & F.col("_found").isNotNull() & F.col(f"_found.{CORRUPT}").isNull()
    return parsed.withColumn(output, F.when(good, F.col("_found"))).drop("_found")


def _only(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([schema[n] for n in names])


def _envelopes(lines: DataFrame) -> DataFrame:
    blank = F.trim(F.col("value"), F.lit(" \t\r\n")) == ""
    return _parse(lines.where(~blank).select("value"), "value", _only(ENVELOPE, "logEvents"),
                  "envelope")


def _messages(lines: DataFrame) -> DataFrame:
    entries = _envelopes(lines).select(
        F.explode_outer("envelope.logEvents").alias("entry")).where(F.col("entry").isNotNull())
    # Neither field is needed to read an event, so none of any JSON type may cost one.
    time = F.coalesce(F.col("entry.timestamp").try_cast("bigint"),
                      F.col("entry.timestamp").try_cast("double").try_cast("bigint"))
    texts = entries.select(F.col("entry.id").alias("log_id"), time.alias("log_time"),
                           F.coalesce(F.col("entry.message"), F.lit("{}")).alias("message"))
    return _parse(texts, "message", _only(MESSAGE, "body", "attributes"), "event")


def parse_events(lines: DataFrame) -> DataFrame:
    """Events ``(log_id, log_time, kind, body, attributes)``.

    Blank lines, malformed envelopes and malformed messages are left out; a missing
    message is an event of unknown kind. Narrow throughout: no shuffle.
    """
    events = _messages(lines).where(F.col("event").isNotNull())
    names = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])
    body = F.coalesce(F.col("event.body"), F.lit(""))
    return events.select(
        "log_id", "log_time",
        F.coalesce(F.try_element_at(names, body), F.lit(UNKNOWN_KIND)).alias("kind"),
        body.alias("body"), F.col("event.attributes").alias("attributes"))


def corrupt_records(lines: DataFrame) -> DataFrame:
    """What ``parse_events`` leaves out: ``(level, text)`` of bad envelopes and messages.

    One pass: a bad envelope goes on beside the messages of the good ones.
    """
    found = _envelopes(lines).select(
        F.when(F.col("envelope").isNull(), F.col("value")).alias("bad_line"), "envelope.logEvents")
    entries = found.select("bad_line", F.explode_outer("logEvents").alias("entry")).where(
        F.col("bad_line").isNotNull() | F.col("entry").isNotNull())
    texts = entries.select("bad_line", F.when(F.col("entry").isNotNull(), F.coalesce(
        F.col("entry.message"), F.lit("{}"))).alias("message"))
    parsed = _parse(texts, "message", _only(MESSAGE, "body", "attributes"), "event")
    is_line = F.col("bad_line").isNotNull()
    return parsed.where(is_line | F.col("event").isNull()).select(
        F.when(is_line, "envelope").otherwise("message").alias("level"),
        F.coalesce("bad_line", "message").alias("text"))


def ingest_report(events: DataFrame) -> DataFrame:
    """Number of events per kind and, in the row 'total', of all."""
    return events.rollup("kind").agg(F.count(F.lit(1)).alias("events")).select(
        F.coalesce("kind", F.lit("total")).alias("kind"), "events").orderBy(
        F.desc("events"), "kind")


# --- fixed values: attribute names in log messages ---
WHOLE_NUMBERS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
                 "duration_ms", "tool_result_size_bytes", "prompt_length", "attempt"]
TEXTS = ["session.id", "user.email", "event.timestamp", "model", "tool_name", "decision", "source",
         "decision_type", "decision_source", "success", "tool_result_size_bytes", "error",
         "status_code"]
# --- end of fixed values ---


def _raw(name: str) -> Column:
    return F.col("attributes")[name]


def _whole(name: str) -> Column:
    return as_whole(_raw(name))


def _real(value: Column) -> Column:
    """An infinite number becomes the default, as in whole-number attributes."""
    number = as_float(F.coalesce(value, F.lit("0")))
    return F.when(F.abs(number) == float("inf"), 0.0).otherwise(number)


def table_columns(kind: str, raw: Callable[[str], Column] = _raw,
                  whole: Callable[[str], Column] = _whole,
                  real: Callable[[str], Column] = lambda n: _real(_raw(n))) -> dict[str, Column]:
    """Typed columns of an event of ``kind``, by name.

    ``raw``, ``whole`` and ``real`` read an attribute as text, as whole number (null if
    absent) and as double (0 if absent).
    """
    def text(name: str, default: str = "") -> Column:
        return F.coalesce(raw(name), F.lit(default))

    def number(name: str, default: int = 0) -> Column:
        return F.coalesce(whole(name), F.lit(default).cast("bigint"))

    common = {"session_id": text("session.id"), "user_email": text("user.email"),
              "timestamp": utc_timestamp(raw("event.timestamp"))}
    if kind == "api_request":
        tokens = {f"{t}_tokens": number(f"{t}_tokens")
                  for t in ("input", "output", "cache_read", "cache_creation")}
        return common | {"model": text("model", "unknown")} | tokens | {
            "total_tokens": sum(tokens.values(), F.lit(0).cast("bigint")),
            "cost_usd": real("cost_usd"),
            "duration_ms": number("duration_ms")}
    if kind == "tool_decision":
        return common | {
            "event_type": F.lit("decision"), "tool_name": text("tool_name"),
            "decision": text("decision"), "source": text("source"),
            "success": F.lit(None).cast("int"), "duration_ms": F.lit(0).cast("bigint"),
            "result_size_bytes": F.lit(None).cast("bigint")}
    if kind == "tool_result":
        return common | {
            "event_type": F.lit("result"), "tool_name": text("tool_name"),
            "decision": text("decision_type"), "source": text("decision_source"),
            "success": as_flag(text("success", "true")), "duration_ms": number("duration_ms"),
            "result_size_bytes": F.when(text("tool_result_size_bytes") != "",
                                        number("tool_result_size_bytes"))}
    if kind == "user_prompt":
        return common | {"prompt_length": number("prompt_length")}
    if kind == "api_error":
        return common | {
            "error_msg": text("error"), "status_code": text("status_code"),
            "model": text("model"), "attempt": number("attempt", 1),
            "duration_ms": number("duration_ms")}
    raise ValueError(f"no table for events of kind {kind!r}")


def typed(events: DataFrame, kind: str) -> DataFrame:
    """The events of one kind with their typed columns."""
    columns = [c.alias(n) for n, c in table_columns(kind).items()]
    return events.where(F.col("kind") == kind).select(*columns)


TABLE_KINDS = {
    "api_requests": ["api_request"], "tool_events": ["tool_decision", "tool_result"],
    "user_prompts": ["user_prompt"], "api_errors": ["api_error"],
}


def route_events(events: DataFrame) -> dict[str, DataFrame]:
    """The four event tables over one stored frame (a job runs when this is called).

    Events are parsed once; a table reads the folders of its kinds.
    """
    path = work_dir(events.sparkSession, "routed")
    frame = typed_events(events).drop("date")
    frame.write.partitionBy("kind").parquet(path)
    stored = events.sparkSession.read.schema(frame.schema).parquet(path)
    return {table: stored.where(F.col("kind").isin(kinds)).select(*table_columns(kinds[0]))
            for table, kinds in TABLE_KINDS.items()}


def typed_events(events: DataFrame) -> DataFrame:
    """Every known event once, with the typed columns of all tables, ``kind`` and ``date``.

    One narrow pass: a load parses each line once and shuffles nothing. Columns that do
    not belong to a kind are null and cost next to nothing in a columnar file. Attributes
    are read by small lambdas over arrays of names; spelled out per kind and column
    the generated method would outgrow what the JVM compiles. Works on streams.
    """
    def found(names: list[str]) -> Column:
        return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: _raw(n))

    known = events.where(F.col("kind") != UNKNOWN_KIND).select(
        "kind", found(TEXTS).alias("_texts"),
        F.transform(found(WHOLE_NUMBERS), as_whole).alias("_numbers"),
        F.transform(found(["cost_usd"]), _real).alias("_reals"))
    by_kind = {kind: table_columns(
        kind, lambda n: F.col("_texts")[TEXTS.index(n)],
        lambda n: F.col("_numbers")[WHOLE_NUMBERS.index(n)],
        lambda _: F.col("_reals")[0]) for kind in EVENT_KINDS.values()}
    shared = ["session_id", "user_email", "timestamp"]
    others = dict.fromkeys(n for c in by_kind.values() for n in c if n not in shared)

    def column(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("kind") == kind, columns[name])
                            for kind, columns in by_kind.items() if name in columns]).alias(name)

    return known.select("kind", *[by_kind["user_prompt"][n].alias(n) for n in shared],
                        *[column(n) for n in others]
                        ).withColumn("date", F.to_date("timestamp"))


# --- packing ----------------------------------------------------------------------


def event_messages(wh: Warehouse) -> DataFrame:
    """Warehouse rows as log messages ``(id, ts, message)``; the tables need an ``id``."""
    body_of = {kind: body for body, kind in EVENT_KINDS.items()}

    def messages(df: DataFrame, kind: str, **attributes: Column | str) -> DataFrame:
        values = {
            "event.timestamp": F.date_format("timestamp", ISO_MILLIS),
            "session.id": F.col("session_id"), "user.email": F.col("user_email"),
            "event.name": F.lit(kind),
        } | {n: F.col(c) if isinstance(c, str) else c for n, c in attributes.items()}
        pairs = [x for name, c in values.items() for x in (F.lit(name), c.cast("string"))]
        bag = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
        event = F.struct(F.lit(body_of[kind]).alias("body"), bag.alias("attributes"))
        return df.select(F.concat(F.lit(f"{kind}-"), F.col("id").cast("string")).alias("id"),
                         F.col("timestamp").alias("ts"), F.to_json(event).alias("message"))

    decided = wh.tool_events.where(F.col("event_type") == "decision")
    finished = wh.tool_events.where(F.col("event_type") == "result")
    success = F.when(F.col("success") == 1, "true").otherwise("false")
    same = {n: n for n in ("model", "input_tokens", "output_tokens", "cache_read_tokens",
                           "cache_creation_tokens", "cost_usd", "duration_ms")}
    frames = [
        messages(wh.api_requests, "api_request", **same),
        messages(decided, "tool_decision", tool_name="tool_name", decision="decision",
                 source="source"),
        messages(finished, "tool_result", tool_name="tool_name", decision_type="decision",
                 decision_source="source", success=success, duration_ms="duration_ms",
                 tool_result_size_bytes="result_size_bytes"),
        messages(wh.user_prompts, "user_prompt", prompt_length="prompt_length"),
        messages(wh.api_errors, "api_error", error="error_msg", status_code="status_code",
                 model="model", attempt="attempt", duration_ms="duration_ms"),
    ]
    return stack(frames)


def pack_envelopes(messages: DataFrame, size: int = 10, slot_seconds: int = 60,
                   salts: int = 1, per_task: int | None = None) -> DataFrame:
    """Envelope lines ``(value, year, month, day)`` of up to ``size`` messages in time order.

    Messages are numbered inside a slot of ``slot_seconds``, so no task sorts a whole
    day. ``salts`` splits every slot further; ``per_task`` instead counts the messages per
    slot and gives each slot as many salts as it takes to hold about so many in one. The
    counts, one row a slot, are stored first (a job runs when this is called), so that
    their size decides how they reach the messages. Year, month and day are those of the first
    message, and a slot never spans two days.
    """
    if per_task is not None and (per_task < 1 or salts != 1):
        raise ValueError("per_task has to be positive and takes the place of salts")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    slotted = messages.select("id", millis.alias("millis"), "message",
                              F.floor(millis / (slot_seconds * 1000)).alias("slot"))
    shares = F.lit(salts).cast("bigint")
    if per_task is not None:
        counts = materialize(slotted.groupBy("slot").agg(F.count(F.lit(1)).alias("held")), "slots")
        counts = counts.withColumnRenamed("slot", "_slot")
        slotted = slotted.join(counts, F.col("slot").eqNullSafe(F.col("_slot")))  # messages without a time too
        shares = F.ceil(F.col("held") / per_task)
    placed = slotted.select("id", "millis", "message", "slot",
                            F.pmod(F.xxhash64("id"), shares).alias("salt"))
    # Messages compress to an eighth. Merged to shuffle partitions of even compressed size they
    # would fill a task's memory, so the number of partitions is kept.
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(tasks, "slot", "salt")
    order = Window.partitionBy("slot", "salt").orderBy("millis", "id")
    packs = placed.withColumn("pack", F.floor((F.row_number().over(order) - 1) / size))
    entry = F.struct("millis", "id", "message")
    groups = packs.groupBy("slot", "salt", "pack").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"))
    first = F.timestamp_millis(F.col("entries")[0]["millis"])
    dated = groups.select("entries", F.year(first).alias("year"), F.month(first).alias("month"),
                          F.dayofmonth(first).alias("day"))
    log_events = F.transform("entries", lambda e: F.struct(
        e["id"].alias("id"), e["millis"].alias("timestamp"), e["message"].alias("message")))
    envelope = F.struct(F.lit("DATA_MESSAGE").alias("messageType"), log_events.alias("logEvents"),
                        "year", "month", "day")
    return dated.select(F.to_json(envelope).alias("value"), "year", "month", "day")


def write_envelopes(packed: DataFrame, path: str) -> None:
    """Text files under ``year=/month=/day=`` folders, few for each day."""
    packed.hint("rebalance", "year", "month", "day").write.mode("overwrite").partitionBy("year", "month", "day").text(path)
