"""Ingest, storage and streaming queries over envelopes packed from the derived tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.functions import coerce
from tallywing.model import EMPLOYEE_FIELDS, EVENT_KINDS
from tallywing.operators import quality
from tallywing.operators.common import stack
from tallywing.operators.sessions import build_sessions, gap_sessions, session_facts
from tallywing.plans import fixtures
from tallywing.plans.quality_queries import REPORT
from tallywing.plans.registry import Catalogue, Inputs, R, S
from tallywing.session import materialize, work_dir
from tallywing.sources import by_session, directory, envelopes, increments, warehouse
from tallywing.streaming import ingest, late, live

CASES = Catalogue()


def _packed(i: Inputs) -> DataFrame:
    return envelopes.pack_envelopes(envelopes.event_messages(i.wh), slot_seconds=3600)


def _lines(i: Inputs) -> DataFrame:
    return _packed(i).select("value")


def _write_lines(lines: DataFrame, path: str) -> str:
    """Log files as they are usually kept, compressed: lines repeat their field names."""
    lines.write.text(path, compression="gzip")
    return path


def _events(i: Inputs) -> DataFrame:
    return envelopes.parse_events(_lines(i))


CASES.add("write_busy_slots", lambda i: envelopes.typed_events(envelopes.parse_events(envelopes.pack_envelopes(
    envelopes.event_messages(i.wh), slot_seconds=86400, per_task=500).select("value"))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions")),
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, count(*) AS events, count(DISTINCT session_id) AS sessions FROM {rows}"
        for kind, rows in (("api_request", "api_requests"), ("tool_decision", "tool_events WHERE event_type = 'decision'"),
                           ("tool_result", "tool_events WHERE event_type = 'result'"),
                           ("user_prompt", "user_prompts"), ("api_error", "api_errors"))))


# --- parsing ----------------------------------------------------------------------

_KIND_ROWS = {
    "api_request": "SELECT * FROM api_requests",
    "tool_decision": "SELECT * FROM tool_events WHERE event_type = 'decision'",
    "tool_result": "SELECT * FROM tool_events WHERE event_type = 'result'",
    "user_prompt": "SELECT * FROM user_prompts",
    "api_error": "SELECT * FROM api_errors",
}
ALL_EVENTS = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, id, session_id, user_email, \"timestamp\" FROM ({rows})"
    for kind, rows in _KIND_ROWS.items())


_BODIES = " ".join(f"WHEN '{kind}' THEN '{body}'" for body, kind in EVENT_KINDS.items())


def _ingest_envelopes(i: Inputs) -> DataFrame:
    return _events(i).select(
        "log_id", "log_time", "kind", "body",
        F.col("attributes")["session.id"].alias("session_id"),
        F.col("attributes")["user.email"].alias("user_email"))


CASES.add("ingest_envelopes", _ingest_envelopes, f"""
    SELECT concat(kind, '-', id::varchar) AS log_id, epoch_ms("timestamp") AS log_time, kind,
           CASE kind {_BODIES} END AS body, session_id, user_email FROM ({ALL_EVENTS})""")


def _ingest_corrupt(i: Inputs) -> DataFrame:
    """Good envelopes mixed with prose as lines and chat turns as messages."""
    junk = i.parquet("documents").select(F.col("text").alias("value"))
    chat = i.parquet("conversations").select(F.to_json(F.struct(F.array(F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("message"))
    ).alias("logEvents"))).alias("value"))
    mixed = stack([_lines(i), junk, chat])
    return envelopes.corrupt_records(mixed).groupBy("level").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("characters"))


CASES.add("ingest_corrupt", _ingest_corrupt, plain="""
    SELECT 'envelope' AS level, count(*) AS records,
           CAST(sum(length(text)) AS bigint) AS characters
    FROM documents WHERE trim(text, E' \\t\\r\\n') <> ''
    UNION ALL
    SELECT 'message', count(*), CAST(sum(length(text)) AS bigint) FROM conversations""")

CASES.add("route_events", lambda i: stack(
    df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"),
           F.countDistinct("session_id").alias("sessions"))
    for name, df in envelopes.route_events(_events(i)).items()), " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, count(DISTINCT session_id) AS sessions FROM {t}"
    for t in envelopes.TABLE_KINDS))

CASES.add("ingest_report", lambda i: envelopes.ingest_report(_events(i)), f"""
    SELECT coalesce(kind, 'total') AS kind, count(*) AS events FROM ({ALL_EVENTS})
    GROUP BY ROLLUP (kind)""")

_EXACT = {"api_request": "* EXCLUDE (id) REPLACE (CAST(cost_usd AS double) AS cost_usd)"}
_KEYS = {"api_request": "ingest_api_requests", "tool_decision": "ingest_tool_decisions",
         "tool_result": "ingest_tool_results", "user_prompt": "ingest_user_prompts",
         "api_error": "ingest_api_errors"}
for _kind, _rows in _KIND_ROWS.items():
    CASES.add(_KEYS[_kind], lambda i, kind=_kind: envelopes.typed(_events(i), kind),
              f"SELECT {_EXACT.get(_kind, '* EXCLUDE (id)')} FROM ({_rows})")


# --- coercion ---------------------------------------------------------------------


def _coerced(i: Inputs, function) -> DataFrame:
    return i.parquet("events").select(
        "event_id", function(F.col("value").cast("string")).alias("from_number"),
        function(F.col("event_id").cast("string")).alias("from_integer"),
        function(F.col("props")).alias("from_text"))


CASES.add("coerce_float", lambda i: _coerced(i, coerce.as_float), plain="""
    SELECT event_id, value AS from_number, CAST(event_id AS double) AS from_integer,
           CAST(0 AS double) AS from_text FROM events""")
CASES.add("coerce_int", lambda i: _coerced(i, coerce.as_int), plain="""
    SELECT event_id, CAST(trunc(value) AS bigint) AS from_number, event_id AS from_integer,
           CAST(0 AS bigint) AS from_text FROM events""")
CASES.add("coerce_bool", lambda i: i.parquet("events").select(
    "event_id", coerce.as_flag((F.col("value") > 50).cast("string")).alias("lower_case"),
    coerce.as_flag(F.upper((F.col("value") > 50).cast("string"))).alias("upper_case"),
    coerce.as_flag(F.col("event_type")).alias("from_text")), plain="""
    SELECT event_id, CAST(value > 50 AS int) AS lower_case, CAST(value > 50 AS int) AS upper_case,
           0 AS from_text FROM events""")


# --- files ------------------------------------------------------------------------


def _employee_csv(i: Inputs) -> str:
    path = work_dir(i.spark, "employees")
    i.wh.employees.select(EMPLOYEE_FIELDS).write.mode("overwrite").csv(path, header=True)
    return path


CASES.add("ingest_employees", lambda i: directory.read_employees(i.spark, _employee_csv(i)),
          "SELECT * FROM employees")


def _envelope_files(i: Inputs) -> str:
    path = work_dir(i.spark, "envelopes")
    envelopes.write_envelopes(_packed(i), path)
    return path


CASES.add("write_envelopes", lambda i: _packed(i).groupBy("year", "month", "day").agg(
    F.count(F.lit(1)).alias("envelopes"),
    F.sum(F.size(F.from_json("value", "logEvents array<struct<id string>>")["logEvents"]))
    .alias("events")), f"""
    WITH slots AS (SELECT epoch_ms("timestamp") // 3600000 AS slot, count(*) AS n,
                          min("timestamp") AS first FROM ({ALL_EVENTS}) GROUP BY 1)
    SELECT CAST(extract(year FROM first) AS int) AS year,
           CAST(extract(month FROM first) AS int) AS month,
           CAST(extract(day FROM first) AS int) AS day,
           CAST(sum((n + 9) // 10) AS bigint) AS envelopes, {S("n")} AS events
    FROM slots GROUP BY 1, 2, 3""")

_TABLE_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in (
        "employees", "sessions", "api_requests", "tool_events", "user_prompts", "api_errors"))


def _load(i: Inputs):
    root, logs = work_dir(i.spark, "warehouse"), work_dir(i.spark, "logs")
    _write_lines(_lines(i), logs)
    return warehouse.load_warehouse(i.spark, logs, _employee_csv(i), root)[0]


def _report_after_load(i: Inputs) -> DataFrame:
    root, logs = work_dir(i.spark, "warehouse"), work_dir(i.spark, "logs")
    _write_lines(_lines(i), logs)
    wh, _ = warehouse.load_warehouse(i.spark, logs, _employee_csv(i), root)
    return quality.quality_report(wh, counters=warehouse.load_counters(i.spark, root))


CASES.add("load_warehouse", lambda i: stack(
    df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
    for name, df in _load(i).items()), _TABLE_COUNTS)
CASES.add("quality_report_loaded", _report_after_load, REPORT)


@cache
def _by_session(spark: SparkSession, sf_dir: str) -> str:
    """A loaded warehouse that is stored by session too."""
    i = Inputs(spark, sf_dir)
    root, logs = work_dir(spark, "by-session"), work_dir(spark, "logs")
    _write_lines(_lines(i), logs)
    warehouse.load_warehouse(spark, logs, _employee_csv(i), root)
    by_session.store_by_session(spark, root)
    return root


CASES.add("sessions_by_bucket", lambda i: by_session.open_by_session(i.spark, _by_session(i.spark, i.sf_dir)).sessions
          .withColumn("total_cost_usd", F.round("total_cost_usd", 6)),
          "SELECT * REPLACE (round(CAST(total_cost_usd AS double), 6) AS total_cost_usd) FROM sessions")
CASES.add("quality_report_by_bucket", lambda i: quality.quality_report(
    by_session.open_by_session(i.spark, _by_session(i.spark, i.sf_dir))), REPORT)
CASES.add("scan_table", lambda i: warehouse.scan_table(i.wh, """
    SELECT model, count(*) AS calls FROM {api_requests}
    WHERE duration_ms >= :slow GROUP BY model""", {"slow": 5000}), """
    SELECT model, count(*) AS calls FROM api_requests WHERE duration_ms >= 5000 GROUP BY model""")


@cache
def _grown(spark: SparkSession, sf_dir: str) -> tuple[str, tuple[increments.Increment, ...]]:
    """A warehouse that grew by three loads; the fourth found nothing new."""
    i = Inputs(spark, sf_dir)
    root, logs, staff = work_dir(spark, "grown"), work_dir(spark, "arriving"), _employee_csv(i)
    lines = materialize(_packed(i).select("value", "day"), "packed")
    done = []
    for third in (0, 1, 2, None):
        if third is not None:
            _write_lines(lines.where(F.col("day") % 3 == third).select("value"), f"{logs}/{third}")
        done.append(increments.load_increment(spark, logs, staff, root))
    return root, tuple(done)


def _increment_counts(i: Inputs) -> DataFrame:
    done = _grown(i.spark, i.sf_dir)[1]
    return i.spark.createDataFrame([(n, d.events, d.files > 0) for n, d in enumerate(done)],
                                   "load int, events bigint, read_files boolean")


CASES.add("load_increment", _increment_counts, f"""
    SELECT CAST(extract(day FROM "timestamp") % 3 AS int) AS load, count(*) AS events, true AS read_files
    FROM ({ALL_EVENTS}) GROUP BY 1 UNION ALL SELECT 3, 0, false""")


def _increment_tables(i: Inputs) -> DataFrame:
    wh = increments.open_increments(i.spark, _grown(i.spark, i.sf_dir)[0])
    return stack(df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, df in wh.items())


CASES.add("increment_tables", _increment_tables, _TABLE_COUNTS)
CASES.add("increment_sessions", lambda i: increments.open_increments(
    i.spark, _grown(i.spark, i.sf_dir)[0]).sessions.withColumn("total_cost_usd", F.round("total_cost_usd", 6)),
    "SELECT * REPLACE (round(CAST(total_cost_usd AS double), 6) AS total_cost_usd) FROM sessions")


# --- streams ----------------------------------------------------------------------


def _ingest_stream(i: Inputs) -> DataFrame:
    out, state = work_dir(i.spark, "stream"), work_dir(i.spark, "state")
    lines = ingest.read_line_stream(i.spark, _envelope_files(i))
    ingest.stream_ingest(lines, out, state).awaitTermination()
    return i.spark.read.parquet(out).groupBy("kind").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions"))


CASES.add("ingest_stream", _ingest_stream, f"""
    SELECT kind, count(*) AS events, count(DISTINCT session_id) AS sessions
    FROM ({ALL_EVENTS}) GROUP BY kind""")


def _stream_ingest(i: Inputs) -> DataFrame:
    """Sessions rebuilt from what a stream has stored."""
    logs, out, state = (work_dir(i.spark, n) for n in ("logs", "stream", "state"))
    _write_lines(_lines(i), logs)
    ingest.stream_ingest(ingest.read_line_stream(i.spark, logs), out, state).awaitTermination()
    tables = warehouse.event_tables(i.spark.read.parquet(out))
    sessions = build_sessions(tables["api_requests"], tables["user_prompts"],
                              tables["tool_events"])
    return sessions.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


CASES.add("stream_ingest", _stream_ingest,
          "SELECT * REPLACE (round(CAST(total_cost_usd AS double), 6) AS total_cost_usd) "
          "FROM sessions")


def _streamed(i: Inputs, table: str) -> DataFrame:
    """A derived table over ``events`` read as a stream."""
    events = i.parquet("events")
    rows = i.spark.readStream.schema(events.schema).option(
        "pathGlobFilter", "events.parquet").parquet(i.sf_dir)
    return getattr(fixtures.DerivedWarehouse(i.spark, i.sf_dir, events=rows), table)


def _stream_dedupe(i: Inputs) -> DataFrame:
    out, state = work_dir(i.spark, "dedupe"), work_dir(i.spark, "state")
    unique = live.stream_dedupe(_streamed(i, "api_requests"))
    (unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return i.spark.read.parquet(out).select(
        "user_email", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "model")


CASES.add("stream_dedupe", _stream_dedupe,
          'SELECT DISTINCT user_email, "timestamp", model FROM api_requests')


def _stream_daily(i: Inputs) -> DataFrame:
    out, state = work_dir(i.spark, "daily"), work_dir(i.spark, "state")
    days = live.stream_daily_activity(_streamed(i, "api_requests"))
    live.store_versions(days, out, state).awaitTermination()
    newest = live.latest_versions(i.spark.read.parquet(out), ["date"])
    return newest.select("date", "api_calls", F.col("cost_usd").cast("double").alias("cost_usd"),
                         "tokens")


CASES.add("stream_daily_activity", _stream_daily, f"""
    SELECT CAST("timestamp" AS date) AS date, count(*) AS api_calls,
           {R("sum(cost_usd)", 6)} AS cost_usd, {S("total_tokens")} AS tokens
    FROM api_requests GROUP BY 1""")


def _stream_sessions(i: Inputs) -> DataFrame:
    out, state = work_dir(i.spark, "fragments"), work_dir(i.spark, "state")
    facts = session_facts(*[_streamed(i, t) for t in (
        "api_requests", "user_prompts", "tool_events")])
    live.store_versions(live.stream_sessions(facts), out, state).awaitTermination()
    sessions = live.sessions_from_fragments(i.spark.read.parquet(out))
    return sessions.withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))


CASES.add("stream_sessions", _stream_sessions,
          "SELECT * REPLACE (CAST(total_cost_usd AS double) AS total_cost_usd) FROM sessions")


# --- streams with late rows, in several runs --------------------------------------

#: Requests arrive in four parts of the period; every fortieth comes a part later than it should.
ARRIVING = """
    SELECT *, CAST(least(3, floor((dayofyear("timestamp") - 1) / 27)) AS int)
              + CASE WHEN id % 40 = 7 THEN 1 ELSE 0 END AS step FROM api_requests"""
_SPLIT = f"""
    WITH arriving AS ({ARRIVING}),
    highs AS (SELECT step, max("timestamp") AS high FROM arriving GROUP BY step),
    marks AS (SELECT a.step, max(b.high) - INTERVAL 1 DAY AS mark
              FROM highs a LEFT JOIN highs b ON b.step < a.step GROUP BY a.step),
    split AS (SELECT a.*, coalesce("timestamp" <= mark, false) AS late, max("timestamp") OVER () AS high
              FROM arriving a JOIN marks USING (step))"""
_STREAMS = ("requests", "unique", "days", "fragments", "gaps")


def _facts_of(requests: DataFrame) -> DataFrame:
    """Facts of requests alone."""
    none = requests.where("false").withColumn("event_type", F.lit("decision"))
    return session_facts(requests, none, none)


@cache
def _arrived(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Stored results of all streams after every part has arrived; each part is a run of each."""
    i = Inputs(spark, sf_dir)
    stores, states = ({n: work_dir(spark, f"{kind}-{n}") for n in _STREAMS} for kind in ("late", "state"))
    incoming = work_dir(spark, "incoming")
    arriving = i.spark.sql(ARRIVING.replace('"timestamp"', "`timestamp`").replace(
        "FROM api_requests", "FROM {requests}"), requests=i.wh.api_requests)
    steps = sorted(r.step for r in arriving.select("step").distinct().collect())
    schema = i.wh.api_requests.schema
    for step in steps:
        arriving.where(F.col("step") == step).drop("step").write.parquet(f"{incoming}/{step}")
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(incoming)
        late.split_late(rows, "timestamp", "1 day", stores["requests"], states["requests"]).awaitTermination()
        requests = late.accepted_stream(spark, stores["requests"])
        runs = [live.store_versions(live.stream_daily_activity(requests), stores["days"], states["days"]),
                live.store_versions(live.stream_sessions(_facts_of(requests)), stores["fragments"], states["fragments"])]
        runs += [df.writeStream.format("parquet").option("path", stores[n]).option("checkpointLocation", states[n])
                 .outputMode("append").trigger(availableNow=True).start()
                 for n, df in (("unique", live.stream_dedupe(requests, delay="1 day")),
                               ("gaps", live.stream_gap_sessions(_facts_of(requests))))]
        for run in runs:
            run.awaitTermination()
            if dropped := late.dropped_by_watermark(run):
                raise RuntimeError(f"{dropped} accepted rows were dropped by a stream")
    return stores


def _stores(i: Inputs) -> dict[str, str]:
    return _arrived(i.spark, i.sf_dir)


def _late(i: Inputs) -> DataFrame:
    return late.late_rows(i.spark, _stores(i)["requests"])


CASES.add("stream_late_rows", lambda i: i.spark.read.parquet(_stores(i)["requests"]).groupBy(
    F.col(late.DAY).alias("date")).agg(F.count_if(F.col(late.LATE) == 0).alias("accepted"),
                                       F.count_if(F.col(late.LATE) == 1).alias("late")),
    _SPLIT + """
    SELECT CAST("timestamp" AS date) AS date, count(*) FILTER (NOT late) AS accepted,
           count(*) FILTER (late) AS late FROM split GROUP BY 1""")

CASES.add("stream_daily_activity_late", lambda i: late.amended_days(
    live.latest_versions(i.spark.read.parquet(_stores(i)["days"]), ["date"]), _late(i)).select(
        "date", "api_calls", F.col("cost_usd").cast("double").alias("cost_usd"), "tokens"), f"""
    SELECT CAST("timestamp" AS date) AS date, count(*) AS api_calls,
           {R("sum(cost_usd)", 6)} AS cost_usd, {S("total_tokens")} AS tokens
    FROM api_requests GROUP BY 1""")

CASES.add("stream_daily_users_late", lambda i: late.amended_days(
    live.latest_versions(i.spark.read.parquet(_stores(i)["days"]), ["date"]), _late(i)).join(
        i.wh.api_requests.groupBy(F.to_date("timestamp").alias("date")).agg(
            F.countDistinct("user_email").alias("active_users")), "date").select(
        "date", "active_users", (F.abs(F.col("active_users_approx") - F.col("active_users"))
                                 <= F.greatest(F.lit(1), 0.05 * F.col("active_users"))).alias("within_bound")), """
    SELECT CAST("timestamp" AS date) AS date, count(DISTINCT user_email) AS active_users, true AS within_bound
    FROM api_requests GROUP BY 1""")

_UNIQUE = ["user_email", "timestamp", "model"]
CASES.add("stream_dedupe_late", lambda i: late.amended_unique(
    i.spark.read.parquet(_stores(i)["unique"]).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")),
    _late(i), _UNIQUE).select(_UNIQUE), 'SELECT DISTINCT user_email, "timestamp", model FROM api_requests')

CASES.add("stream_sessions_late", lambda i: live.sessions_from_fragments(
    i.spark.read.parquet(_stores(i)["fragments"]), late.late_fragments(_facts_of(_late(i)))).select(
        "session_id", "user_email", "start_time", "end_time", "num_api_calls", "total_tokens"), f"""
    SELECT session_id, max(user_email) AS user_email, min("timestamp") AS start_time, max("timestamp") AS end_time,
           count(*) AS num_api_calls, {S("total_tokens")} AS total_tokens FROM api_requests GROUP BY session_id""")

#: Gaps and islands: a row more than half an hour after the user's last one begins a session.
_ISLANDS = """
    begun AS (SELECT *, CASE WHEN "timestamp" - lag("timestamp") OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
              FROM {rows} WINDOW w AS (PARTITION BY user_email ORDER BY "timestamp")),
    placed AS (SELECT *, sum(new) OVER (PARTITION BY user_email ORDER BY "timestamp"
                                        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM begun),
    islands AS (SELECT user_email, min("timestamp") AS start_time, max("timestamp") AS end_time,
                       count(*) AS num_api_calls, CAST(sum(total_tokens) AS bigint) AS total_tokens
                FROM placed GROUP BY user_email, island)"""
_GAP_COLUMNS = ["user_email", "start_time", "end_time", "num_api_calls", "total_tokens"]

CASES.add("gap_sessions", lambda i: gap_sessions(_facts_of(i.wh.api_requests)).select(_GAP_COLUMNS),
          "WITH " + _ISLANDS.format(rows="api_requests") + " SELECT * FROM islands")

CASES.add("stream_gap_sessions", lambda i: i.spark.read.parquet(_stores(i)["gaps"]).select(_GAP_COLUMNS),
          _SPLIT + ", accepted AS (SELECT * FROM split WHERE NOT late)," + _ISLANDS.format(rows="accepted") + """
    SELECT * FROM islands
    WHERE end_time + INTERVAL 30 MINUTE <= (SELECT max(high) FROM split) - INTERVAL 1 DAY""")
