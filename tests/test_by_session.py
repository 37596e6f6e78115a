"""Tables stored by session: equal to a plain load, and planned without moving events."""

import uuid

import pytest
from builders import at, make, rows
from pyspark.sql import functions as F

from tallywing.operators import quality
from tallywing.operators.sessions import build_sessions, event_facts, session_facts
from tallywing.sources import envelopes, warehouse
from tallywing.sources.by_session import (
    COLUMNS, _read, busy_sessions, open_by_session, sessions_of, store_by_session)

BUCKETS = 4


def moved(df):
    """Exchanges of the plan that carry more than an aggregate's single row."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange roundrobin") + plan.count("BroadcastExchange")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Forty sessions; a third of all prompts belong to s0, some requests to no known session."""
    folder = tmp_path_factory.mktemp("by-session")
    requests = [{"session_id": f"s{k % 40}", "user_email": f"u{k % 3}@x", "timestamp": at(f"2024-01-0{1 + k % 3} 10:00:{k % 60:02d}"),
                 "cost_usd": 0.25 * k} for k in range(120)] + [{"session_id": ""}]
    prompts = [{"session_id": "s0", "timestamp": at(f"2024-01-02 11:{k:02d}:00")} for k in range(60)] + [
        {"session_id": f"s{k}"} for k in range(0, 40, 3)]
    tools = [{"session_id": f"s{k}", "event_type": kind, "success": 1} for k in range(0, 40, 2) for kind in ("decision", "result")]
    errors = [{"session_id": "s1"}]
    wh = make(spark, api_requests=requests, user_prompts=prompts, tool_events=tools, api_errors=errors,
              employees=[{"email": f"u{k}@x"} for k in range(3)])
    logs, staff = str(folder / "logs"), folder / "staff.csv"
    envelopes.pack_envelopes(envelopes.event_messages(wh)).select("value").write.text(logs)
    staff.write_text("email,full_name,practice,level,location\nu0@x,A,Data,L3,Here\n")
    place = str(folder / "warehouse")
    warehouse.load_warehouse(spark, logs, str(staff), place)
    with pytest.raises(FileNotFoundError):
        open_by_session(spark, place)
    store_by_session(spark, place, BUCKETS)
    return place


def ordered(df):
    return sorted(map(str, df.withColumn("total_cost_usd", F.round("total_cost_usd", 6)).collect()))


def test_sessions_equal_a_plain_load(spark, root):
    plain, stored = warehouse.open_warehouse(spark, root), open_by_session(spark, root)
    assert ordered(stored.sessions) == ordered(plain.sessions) and stored.sessions.count() == 41
    assert [n for n, _ in stored.items()] == [n for n, _ in plain.items()]
    # Whole tables of the parts may be grouped and united after aggregation.
    again = stored.sessions.groupBy("session_id").count()
    assert again.count() == 41 and again.where("count > 1").isEmpty()


def test_busy_sessions_lie_apart(spark, root):
    quiet, busy = open_by_session(spark, root).parts
    assert {r["session_id"] for r in rows(busy.sessions)} == {"s0"}
    assert busy.user_prompts.count() == 61
    # The part's own sessions, from tables that are not united before they are folded.
    assert quiet.sessions.count() == quiet.sessions.select("session_id").distinct().count() == 40
    events = spark.range(100).select(F.when(F.col("id") < 60, None).otherwise(F.col("id")).cast("string").alias("session_id"))
    assert [r["_busy"] for r in rows(busy_sessions(events, 4))] == [None]
    assert busy_sessions(events.limit(0), 4).isEmpty()


def test_checks_equal_a_plain_load(spark, root):
    plain, stored = warehouse.open_warehouse(spark, root), open_by_session(spark, root)
    assert quality.quality_report(stored).collect() == quality.quality_report(plain).collect()
    for count in (quality.requests_outside_sessions, quality.sessions_without_prompt):
        assert count(stored).first() == count(plain).first()
    assert quality.requests_outside_sessions(plain).first()[0] > 0 < quality.sessions_without_prompt(plain).first()[0]


def test_events_by_session_are_not_moved(spark, root):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        quiet = open_by_session(spark, root).parts[0]
        reach = quiet.api_requests.groupBy("session_id").agg(F.min("timestamp").alias("first"))
        silent = quiet.sessions.join(quiet.user_prompts.select("session_id").distinct(), "session_id", "left_anti")
        plain = warehouse.open_warehouse(spark, root)
        for df in (reach.join(quiet.sessions, "session_id"), silent):
            assert moved(df) == 0
        assert moved(plain.sessions.join(plain.user_prompts.select("session_id").distinct(), "session_id", "left_anti")) > 0
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_sessions_of_stored_events_are_folded_in_place(spark, root):
    folder = warehouse.current_folder(spark, root)
    entry = spark.read.parquet(f"{folder}/by-session").first()
    schema = spark.read.parquet(f"{folder}/events").select(*COLUMNS).schema
    events = _read(spark, f"{folder}/{entry['name']}/quiet-events", entry["buckets"], schema)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sessions = sessions_of(events)
        assert moved(sessions) == 0 and sessions.count() == 40
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tallywing_")]


def test_facts_of_one_frame_equal_those_of_tables(spark, root):
    plain = warehouse.open_warehouse(spark, root)
    events = spark.read.parquet(f"{warehouse.current_folder(spark, root)}/events")
    assert ordered(sessions_of(events)) == ordered(build_sessions(plain.api_requests, plain.user_prompts, plain.tool_events))
    apart = session_facts(plain.api_requests, plain.user_prompts, plain.tool_events)
    names = ["session_id", "user_email", "ts", "turns", "calls", "decisions", "tokens"]
    assert sorted(map(str, event_facts(events).select(names).collect())) == sorted(map(str, apart.select(names).collect()))


def test_where_nothing_is_loaded_and_relative_paths(spark, tmp_path):
    with pytest.raises(ValueError):
        store_by_session(spark, f"relative/{uuid.uuid4().hex}")
    with pytest.raises(FileNotFoundError):
        store_by_session(spark, str(tmp_path / "none"))


def test_nothing_left_for_the_buckets(spark, tmp_path):
    """One session holds every event."""
    wh = make(spark, api_requests=[{}] * 5)
    logs, staff, place = str(tmp_path / "logs"), tmp_path / "staff.csv", str(tmp_path / "warehouse")
    staff.write_text("email,full_name,practice,level,location\na@x,A,Data,L3,Here\n")
    envelopes.pack_envelopes(envelopes.event_messages(wh)).select("value").write.text(logs)
    warehouse.load_warehouse(spark, logs, str(staff), place)
    store_by_session(spark, place, BUCKETS)
    stored = open_by_session(spark, place)
    assert stored.sessions.count() == 1 and stored.parts[0].sessions.isEmpty()
    assert quality.sessions_without_prompt(stored).first()[0] == 1
