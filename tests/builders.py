"""Small hand-written tables."""

from datetime import datetime

from tallywing import Warehouse
from tallywing.operators.sessions import build_sessions

SCHEMAS = {
    "employees": "email string, full_name string, practice string, level string, "
                 "location string, level_num int",
    "api_requests": "id bigint, session_id string, user_email string, timestamp timestamp_ntz, "
                    "model string, input_tokens bigint, output_tokens bigint, "
                    "cache_read_tokens bigint, cache_creation_tokens bigint, "
                    "total_tokens bigint, cost_usd double, duration_ms bigint",
    "tool_events": "id bigint, session_id string, user_email string, timestamp timestamp_ntz, "
                   "event_type string, tool_name string, decision string, source string, "
                   "success int, duration_ms bigint, result_size_bytes bigint",
    "user_prompts": "id bigint, session_id string, user_email string, timestamp timestamp_ntz, "
                    "prompt_length bigint",
    "api_errors": "id bigint, session_id string, user_email string, timestamp timestamp_ntz, "
                  "error_msg string, status_code string, model string, attempt bigint, "
                  "duration_ms bigint",
}

DEFAULTS = {
    "employees": {"full_name": "Someone", "practice": "Data", "level": "L3",
                  "location": "Here", "level_num": 3},
    "api_requests": {"model": "m", "input_tokens": 1, "output_tokens": 1, "cache_read_tokens": 0,
                     "cache_creation_tokens": 0, "total_tokens": 2, "cost_usd": 1.0,
                     "duration_ms": 1000},
    "tool_events": {"event_type": "decision", "tool_name": "t", "decision": "accept",
                    "source": "config", "duration_ms": 0},
    "user_prompts": {"prompt_length": 10},
    "api_errors": {"error_msg": "bad", "status_code": "500", "model": "m", "attempt": 1,
                   "duration_ms": 5},
}


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def table(spark, name, rows):
    """Rows are dicts; missing columns take the table's default."""
    names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    filled = []
    for number, row in enumerate(rows):
        whole = {"id": number, "session_id": "s1", "user_email": "a@x",
                 "timestamp": at("2024-01-01 10:00:00")} | DEFAULTS[name] | row
        filled.append(tuple(whole.get(n) for n in names))
    return spark.createDataFrame(filled, SCHEMAS[name])


def make(spark, **tables):
    frames = {name: table(spark, name, tables.get(name, [])) for name in SCHEMAS}
    sessions = tables.get("sessions")
    if sessions is None:
        sessions = build_sessions(frames["api_requests"], frames["user_prompts"],
                                  frames["tool_events"])
    return Warehouse(sessions=sessions, **frames)


SESSION_SCHEMA = ("session_id string, user_email string, start_time timestamp_ntz, "
                  "end_time timestamp_ntz, duration_min double, num_turns bigint, "
                  "num_api_calls bigint, num_tool_calls bigint, total_cost_usd double, "
                  "total_tokens bigint")


def sessions(spark, rows):
    """``rows`` of (user, start) or dicts."""
    out = []
    for number, row in enumerate(rows):
        if not isinstance(row, dict):
            row = {"user_email": row[0], "start_time": at(row[1])}
        whole = {"session_id": f"s{number}", "end_time": row["start_time"], "duration_min": 1.0,
                 "num_turns": 1, "num_api_calls": 1, "num_tool_calls": 0, "total_cost_usd": 1.0,
                 "total_tokens": 10} | row
        out.append(tuple(whole[c.split()[0]] for c in SESSION_SCHEMA.split(", ")))
    return spark.createDataFrame(out, SESSION_SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]
