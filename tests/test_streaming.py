import json
from datetime import timedelta

import pytest
from builders import at, make, rows, table
from pyspark.sql import functions as F

from tallywing.operators.sessions import session_facts
from tallywing.sources import envelopes, warehouse
from tallywing.streaming import ingest, late, live


def lines_of(wh):
    packed = envelopes.pack_envelopes(envelopes.event_messages(wh), size=3, slot_seconds=3600)
    return packed.select("value")


def test_files_arriving_later_are_ingested_once(spark, derived, tmp_path):
    logs, out, state = (str(tmp_path / n) for n in ("logs", "out", "state"))
    everything = lines_of(derived)
    everything.coalesce(1).write.text(logs)
    ingest.stream_ingest(ingest.read_line_stream(spark, logs), out, state).awaitTermination()
    extra = make(spark, api_requests=[{"session_id": "late"}])
    lines_of(extra).coalesce(1).write.mode("append").text(logs)
    for _ in range(2):  # the second run finds nothing new
        ingest.stream_ingest(ingest.read_line_stream(spark, logs), out, state).awaitTermination()
    tables = warehouse.event_tables(spark.read.parquet(out))
    assert tables["api_requests"].count() == derived.api_requests.count() + 1
    assert tables["tool_events"].count() == derived.tool_events.count()
    assert tables["api_requests"].where("session_id = 'late'").count() == 1


def test_plan_of_the_stream_is_the_plan_of_the_batch(spark, tmp_path):
    path = tmp_path / "one.jsonl"
    path.write_text(json.dumps({"logEvents": [{"id": "1", "message": "{}"}]}) + "\n")
    batch = envelopes.typed_events(envelopes.parse_events(envelopes.read_lines(spark, str(path))))
    stream = envelopes.typed_events(envelopes.parse_events(
        ingest.read_line_stream(spark, str(tmp_path))))
    assert batch.schema == stream.schema and stream.isStreaming


@pytest.fixture
def batches(spark, tmp_path):
    """A stream of request rows, one file per step."""
    def start(*steps):
        folder = tmp_path / "rows"
        for number, step in enumerate(steps):
            table(spark, "api_requests", step).coalesce(1).write.parquet(f"{folder}/{number}")
        schema = table(spark, "api_requests", []).schema
        return (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
                .option("maxFilesPerTrigger", 1).parquet(str(folder)))
    return start


def test_dedupe_across_batches(spark, batches, tmp_path):
    same = {"timestamp": at("2024-01-01 10:00:00")}
    stream = batches([same, same, same | {"model": "other"}], [same])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    (live.stream_dedupe(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(out).count() == 2


def test_daily_activity_updates(spark, batches, tmp_path):
    stream = batches([{"timestamp": at("2024-01-01 10:00:00")}],
                     [{"timestamp": at("2024-01-01 11:00:00"), "user_email": "b@x"},
                      {"timestamp": at("2024-01-02 11:00:00")}])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.store_versions(live.stream_daily_activity(stream), out, state).awaitTermination()
    newest = rows(live.latest_versions(spark.read.parquet(out), ["date"]))
    got = {str(r["date"]): (r["api_calls"], r["active_users_approx"]) for r in newest}
    assert got == {"2024-01-01": (2, 2), "2024-01-02": (1, 1)}


def test_sessions_over_batches_and_midnight(spark, batches, tmp_path):
    start = at("2024-01-01 23:50:00")
    stream = batches([{"timestamp": start}], [{"timestamp": start + timedelta(minutes=20)}],
                     [{"timestamp": start + timedelta(minutes=25), "session_id": "s2"}])
    nothing = stream.where("false").withColumn("event_type", F.lit("decision"))
    facts = session_facts(stream, nothing, nothing)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.store_versions(live.stream_sessions(facts), out, state).awaitTermination()
    got = {r["session_id"]: r for r in rows(
        live.sessions_from_fragments(spark.read.parquet(out)))}
    assert got["s1"]["num_api_calls"] == 2 and got["s1"]["duration_min"] == 20.0
    assert got["s1"]["start_time"] == start and got["s2"]["num_api_calls"] == 1


def test_late_split_stores_files_per_day_not_per_reading_task(spark, tmp_path):
    rows_in, out, state = (str(tmp_path / n) for n in ("rows", "out", "state"))
    start = at("2024-01-01 10:00:00")
    requests = table(spark, "api_requests", [{"timestamp": start + timedelta(hours=8 * k)} for k in range(24)])
    requests.repartition(8).write.parquet(rows_in)
    with_parts = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # one task per file
    try:
        stream = spark.readStream.schema(requests.schema).parquet(rows_in)
        run = late.split_late(stream, "timestamp", "1 day", out, state)
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_parts)
    stored = spark.read.parquet(out)
    days = stored.select(late.DAY).distinct().count()
    assert stored.select(F.input_file_name()).distinct().count() == days == 9
    assert late.arrivals(run) == (24, 0) and stored.count() == 24
