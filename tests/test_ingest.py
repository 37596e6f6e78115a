import json
import re
import math

import pytest
from builders import rows
from pyspark.sql import functions as F

from tallywing.functions import coerce
from tallywing.functions.numeric import rounded
from tallywing.model import EMPLOYEE_FIELDS, EVENT_KINDS
from tallywing.operators import quality
from tallywing.sources import directory, envelopes, warehouse

BODY = {kind: body for body, kind in EVENT_KINDS.items()}


def message(kind, **attributes):
    named = {k.replace("__", "."): v for k, v in attributes.items()}
    return json.dumps({"body": BODY.get(kind, kind), "attributes": named})


def line(*messages):
    return json.dumps({"messageType": "DATA_MESSAGE", "logEvents": [
        {"id": str(n), "timestamp": 1, "message": m} for n, m in enumerate(messages)],
        "year": 2024, "month": 1, "day": 1})


def frame(spark, *lines):
    return spark.createDataFrame([(text,) for text in lines], "value string")


def parsed(spark, *messages):
    return envelopes.parse_events(frame(spark, line(*messages)))


def test_bad_lines_and_messages_are_skipped_and_counted(spark):
    lines = frame(
        spark, "", "   ", "bad json", "{}", '{"logEvents": []}',
        '{"logEvents": [{"id": "1"}]}',  # no message: an event of unknown kind
        line("oops{", message("api_request"), '{"body": "x"} tail'),
        '{"logEvents": [} ', line(message("something_else")))
    events = envelopes.parse_events(lines)
    kinds = sorted(r["kind"] for r in events.collect())
    assert kinds == ["api_request", "unknown", "unknown"]
    corrupt = sorted((r["level"], r["text"]) for r in envelopes.corrupt_records(lines).collect())
    assert [level for level, _ in corrupt] == ["envelope", "envelope", "message", "message"]
    assert {text for level, text in corrupt if level == "message"} == {
        "oops{", '{"body": "x"} tail'}


def test_report_counts_kinds_and_total(spark):
    report = envelopes.ingest_report(parsed(
        spark, message("api_request"), message("api_request"), message("user_prompt"),
        message("other")))
    assert {r["kind"]: r["events"] for r in report.collect()} == {
        "total": 4, "api_request": 2, "user_prompt": 1, "unknown": 1}


@pytest.mark.parametrize("text, number", [
    ("12.9", 12), ("1e3", 1000), (" 12 ", 12), ("", 0), ("nan", 0), (None, 0), ("-3.7", -3),
    ("12d", 0), ("1_000", 1000), ("abc", 0), ("inf", 0), ("+5", 5), (".5", 0), ("5.", 5)])
def test_integers(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(coerce.as_int(F.col("t")).alias("n")).first()["n"] == number


@pytest.mark.parametrize("text, number", [
    ("0.25", 0.25), ("nan", None), ("x", 0.0), (None, 0.0), ("1e-3", 0.001), ("2f", 0.0)])
def test_floats(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(coerce.as_float(F.col("t")).alias("n")).first()["n"] == number


def test_infinity_is_a_float(spark):
    df = spark.createDataFrame([("-inf",)], "t string")
    assert df.select(coerce.as_float(F.col("t")).alias("n")).first()["n"] == -math.inf


def test_flags(spark):
    df = spark.createDataFrame([("TRUE",), ("true",), ("no",), (None,)], "t string")
    assert [r[0] for r in df.select(coerce.as_flag(F.col("t"))).collect()] == [1, 1, 0, 0]


def test_defaults_of_each_kind(spark):
    events = parsed(spark, message("api_request"), message("tool_decision"),
                    message("tool_result"), message("user_prompt"), message("api_error"))
    tables = {name: rows(df) for name, df in envelopes.route_events(events).items()}
    request = tables["api_requests"][0]
    assert request["model"] == "unknown" and request["session_id"] == ""
    assert request["total_tokens"] == 0 and request["cost_usd"] == 0.0
    assert request["timestamp"] is None
    decision, result = sorted(tables["tool_events"], key=lambda r: r["event_type"])
    assert decision["success"] is None and decision["duration_ms"] == 0
    assert result["success"] == 1 and result["result_size_bytes"] is None
    error = tables["api_errors"][0]
    assert error["model"] == "" and error["attempt"] == 1
    assert tables["user_prompts"][0]["prompt_length"] == 0


def test_values_of_requests_and_results(spark):
    events = parsed(
        spark,
        message("api_request", input_tokens="1", output_tokens="2", cache_read_tokens="3",
                cache_creation_tokens="4", cost_usd="nan", event__timestamp="2024-01-02T03:04:05.678Z"),
        message("api_request", input_tokens=7, event__timestamp="2024-01-02T03:04:05.678+02:00"),
        message("tool_result", success="no", tool_result_size_bytes="0", decision_type="accept"),
        message("tool_result", success="TRUE", tool_result_size_bytes=""))
    requests = sorted(rows(envelopes.typed(events, "api_request")), key=lambda r: r["total_tokens"])
    assert [r["total_tokens"] for r in requests] == [7, 10]
    assert requests[1]["cost_usd"] is None
    assert str(requests[1]["timestamp"]) == "2024-01-02 03:04:05.678000"
    assert str(requests[0]["timestamp"]) == "2024-01-02 01:04:05.678000"
    results = rows(envelopes.typed(events, "tool_result"))
    assert sorted((r["success"], r["result_size_bytes"]) for r in results if r["success"] == 0
                  ) == [(0, 0)]
    assert [r["result_size_bytes"] for r in results if r["success"] == 1] == [None]


def test_typed_events_equal_the_routed_tables(spark):
    events = parsed(spark, message("api_request", model="m", cost_usd="1.5"),
                    message("tool_decision", tool_name="t"), message("tool_result"),
                    message("user_prompt", prompt_length="9"), message("api_error", error="e"),
                    message("unheard_of"))
    stored = envelopes.typed_events(events)
    assert stored.count() == 5
    routed = envelopes.route_events(events)
    for name, df in warehouse.event_tables(stored).items():
        assert df.dtypes == routed[name].dtypes
        assert sorted(map(str, rows(df))) == sorted(map(str, rows(routed[name])))


def test_employees(spark, tmp_path):
    path = tmp_path / "employees.csv"
    path.write_text("email,full_name,practice,level,location\n"
                    "a@x,Ann,Data,L1,Oslo\n"
                    "short@x,Too,Short,L2\n"
                    "\n"
                    "b@x,Bo \"the\" Bee,Web,X9,New York, NY\n"
                    "a@x,Ann,Cloud,L10,Rome\n")
    got = {r["email"]: r for r in rows(directory.read_employees(spark, str(path)))}
    assert set(got) == {"a@x", "b@x"}
    assert got["a@x"]["practice"] == "Cloud" and got["a@x"]["level_num"] == 10
    assert got["b@x"]["location"] == "New York, NY" and got["b@x"]["level_num"] == 0
    assert got["b@x"]["full_name"] == 'Bo "the" Bee'


def test_quoted_employees(spark, tmp_path):
    path = tmp_path / "employees.csv"
    path.write_text('email,full_name,practice,level,location\na@x,"Bee, Ann",Data,L2,Oslo\n')
    got = rows(directory.read_employees(spark, str(path), quoted=True))
    assert got == [{"email": "a@x", "full_name": "Bee, Ann", "practice": "Data", "level": "L2",
                    "location": "Oslo", "level_num": 2}]


def test_packing_limits_size_and_keeps_all(spark, derived):
    messages = envelopes.event_messages(derived)
    for options in ({"slot_seconds": 86400}, {"slot_seconds": 86400, "salts": 3}, {}):
        packed = envelopes.pack_envelopes(messages, size=4, **options)
        sizes = [len(json.loads(r["value"])["logEvents"]) for r in packed.collect()]
        assert max(sizes) <= 4 and sum(sizes) == messages.count()
    first = json.loads(packed.first()["value"])
    stamps = [e["timestamp"] for e in first["logEvents"]]
    assert stamps == sorted(stamps)


def test_busy_slots_get_more_salts(spark):
    """A hot second, a quiet one and messages without a time: all kept, none in one task."""
    times = ["2024-01-01T10:00:00"] * 900 + ["2024-01-01T10:00:05"] * 7 + [None] * 300
    df = spark.createDataFrame([(f"m{n}", t, "{}") for n, t in enumerate(times)], "id string, t string, message string"
                               ).select("id", F.to_timestamp_ntz("t").alias("ts"), "message")
    packed = envelopes.pack_envelopes(df, size=10, slot_seconds=1, per_task=100)
    lines = [json.loads(r["value"])["logEvents"] for r in packed.collect()]
    assert sorted(e["id"] for line in lines for e in line) == sorted(f"m{n}" for n in range(len(times)))
    assert max(map(len, lines)) == 10
    # Each salt has at most one line that is not full: 9 of the hot second, 1, and 3.
    assert 2 < sum(len(line) < 10 for line in lines) <= 13
    for wrong in ({"per_task": 0}, {"per_task": 5, "salts": 2}):
        with pytest.raises(ValueError):
            envelopes.pack_envelopes(df, **wrong)


def test_load_open_skip_and_force(spark, derived, tmp_path):
    logs, staff, root = (str(tmp_path / n) for n in ("logs", "staff", "root"))
    packed = envelopes.pack_envelopes(envelopes.event_messages(derived), slot_seconds=86400)
    packed.coalesce(1).select("value").write.text(logs)
    derived.employees.drop("level_num").coalesce(1).write.csv(staff, header=True)
    wh, counts = warehouse.load_warehouse(spark, logs, staff, root)
    assert counts["api_request"] == derived.api_requests.count() == wh.api_requests.count()
    assert counts["total"] == sum(v for k, v in counts.items() if k != "total")
    assert wh.sessions.count() == derived.sessions.count()
    stored = warehouse.load_counters(spark, root)
    (seen,), (counted,) = rows(stored), rows(quality.request_counters(wh))
    assert seen == pytest.approx(counted, rel=1e-9) and stored.columns == list(counted)
    for check in (quality.check_null_rates, quality.check_value_ranges, quality.check_business_rules):
        scans = [re.findall(r"kind#\d+ = api_request\b", check(wh, c)._jdf.queryExecution().executedPlan().toString())
                 for c in (None, stored)]
        assert scans[0] and not scans[1]
        assert rows(check(wh, stored)) == rows(check(wh))
    again, skipped = warehouse.load_warehouse(spark, logs, staff, root)
    assert skipped == {} and again.employees.count() == derived.employees.count()
    wh, forced = warehouse.load_warehouse(spark, logs, staff, root, force=True)
    assert forced == counts
    plan = wh.api_requests.where("user_email = 'a@x'")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_email), EqualTo(user_email,a@x)]" in plan
    assert "PartitionFilters: [isnotnull(kind" in plan
    calls = warehouse.scan_table(wh, "SELECT count(*) AS n FROM {api_requests} WHERE model = :m",
                                 {"m": "model-1"}).first()["n"]
    assert calls == wh.api_requests.where("model = 'model-1'").count()


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        warehouse.load_warehouse(spark, str(tmp_path / "no"), str(tmp_path / "none"),
                                 str(tmp_path / "root"))


def test_nothing_is_lost_to_fields_or_white_space(spark):
    """Times of any JSON type, padded lines and padded messages all give their events."""
    message = json.dumps({"body": "other", "attributes": {"session.id": "s", "cost_usd": "inf"}})
    entries = [{"id": "a", "timestamp": t, "message": m} for t, m in (
        ("1700000000000", message), (1700000000000.5, message + "\n"), (None, "\t\r\n" + message),
        ({"odd": 1}, message), (1700000000000, message))]
    lines = ["\t" + json.dumps({"logEvents": entries}) + " \t", "\r\n", "{no"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    events = envelopes.parse_events(df).collect()
    assert [e["log_time"] for e in events] == [1700000000000, 1700000000000, None, None, 1700000000000]
    assert [(r["level"], r["text"]) for r in envelopes.corrupt_records(df).collect()] == [("envelope", "{no")]


def test_infinite_cost_is_kept_out(spark):
    body = next(b for b, kind in EVENT_KINDS.items() if kind == "api_request")
    texts = [json.dumps({"logEvents": [{"id": "a", "timestamp": 1, "message": json.dumps(
        {"body": body, "attributes": {"cost_usd": c}})}]}) for c in ("inf", "1e30", "0.5")]
    events = envelopes.parse_events(spark.createDataFrame([(t,) for t in texts], "value string"))
    costs = [r["cost_usd"] for r in envelopes.typed_events(events).collect()]
    assert costs == [0.0, 1e30, 0.5]
    assert spark.range(1).select(rounded(F.lit(1e30), 2).alias("a"), rounded(F.lit(0.004999999999), 2).alias("b"),
                                 rounded(F.lit(1.005), 2).alias("c")).first() == (1e30, 0.0, 1.01)


def test_unfinished_load_is_not_seen(spark, derived, tmp_path):
    logs, staff, root = (str(tmp_path / n) for n in ("logs", "staff", "root"))
    envelopes.pack_envelopes(envelopes.event_messages(derived)).select("value").write.text(logs)
    derived.employees.select(EMPLOYEE_FIELDS).write.csv(staff, header=True)
    first, _ = warehouse.load_warehouse(spark, logs, staff, root)
    with pytest.raises(Exception):
        warehouse.load_warehouse(spark, logs, str(tmp_path / "none"), root, force=True)
    assert warehouse.open_warehouse(spark, root).sessions.count() == first.sessions.count()
    day = first.api_requests.agg(F.to_date(F.min("timestamp"))).first()[0].isoformat()
    one_day = warehouse.open_warehouse(spark, root, day, day)
    assert 0 < one_day.api_requests.count() < first.api_requests.count()
    assert "date" in one_day.api_requests._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    report = {r["check_name"]: r["status"] for r in quality.quality_report(first).collect()}
    assert report["schema_completeness"] == "PASS"
    before = {t.name for t in spark.catalog.listTables()}
    warehouse.scan_table(first, "SELECT count(*) AS n FROM {sessions}").collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_session_in_another_zone_is_refused(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        with pytest.raises(ValueError, match="UTC"):
            warehouse.load_warehouse(spark, str(tmp_path), str(tmp_path), str(tmp_path / "root"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_packing_keeps_its_partitions(spark, derived):
    packed = envelopes.pack_envelopes(envelopes.event_messages(derived), slot_seconds=3600)
    assert packed.select(F.spark_partition_id()).distinct().count() == 4


def test_routed_tables_are_parsed_once(spark):
    events = parsed(spark, message("api_request"), message("tool_result"), message("user_prompt"))
    for df in envelopes.route_events(events).values():
        assert "from_json" not in df._jdf.queryExecution().toString()


def test_corrupt_records_read_lines_once(spark):
    lines = spark.createDataFrame([
        ("{no",), (" ",), (None,), ("{}",), ('{"logEvents": []}',), ('{"logEvents": [null]}',),
        (json.dumps({"logEvents": [{"id": "1", "message": "oops{"}, {"id": "2"}, {"id": "3", "message": "{}"}]}),)],
        "value string")
    found = envelopes.corrupt_records(lines)
    assert sorted((r["level"], r["text"]) for r in found.collect()) == [("envelope", "{no"), ("message", "oops{")]
    assert "Union" not in found._jdf.queryExecution().toString()
