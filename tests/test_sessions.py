from builders import at, make, rows, sessions, table
from pyspark.sql import functions as F

from tallywing.functions.timeparts import minutes_between, week_label
from tallywing.operators.sessions import build_sessions, upsert_latest


def test_counts_cost_and_window(spark):
    wh = make(
        spark,
        api_requests=[{"timestamp": at("2024-01-01 10:00:10"), "cost_usd": 0.5},
                      {"timestamp": at("2024-01-01 10:05:00"), "cost_usd": 0.25}],
        user_prompts=[{"timestamp": at("2024-01-01 09:59:00")}],
        tool_events=[{"timestamp": at("2024-01-01 10:02:00")},
                     {"timestamp": at("2024-01-01 10:10:00"), "event_type": "result"}],
        api_errors=[{"timestamp": at("2024-01-01 23:00:00")}])
    (s,) = rows(wh.sessions)
    assert (s["num_turns"], s["num_api_calls"], s["num_tool_calls"]) == (1, 2, 1)
    assert s["start_time"] == at("2024-01-01 09:59:00")
    assert s["end_time"] == at("2024-01-01 10:10:00") and s["duration_min"] == 11.0
    assert s["total_cost_usd"] == 0.75 and s["total_tokens"] == 4


def test_errors_alone_make_no_session(spark):
    assert make(spark, api_errors=[{}]).sessions.count() == 0


def test_two_emails_keep_the_greatest_and_its_window(spark):
    wh = make(
        spark,
        api_requests=[{"user_email": "a@x", "timestamp": at("2024-01-01 08:00:00")},
                      {"user_email": "a@x", "timestamp": at("2024-01-01 12:00:00")}],
        user_prompts=[{"user_email": "z@x", "timestamp": at("2024-01-01 09:00:00")}])
    (s,) = rows(wh.sessions)
    assert s["user_email"] == "z@x" and s["num_api_calls"] == 2 and s["num_turns"] == 1
    assert s["start_time"] == s["end_time"] == at("2024-01-01 09:00:00")


def test_sessions_do_not_depend_on_partitioning(spark, derived):
    def spread(df, n):
        return df.repartition(n)

    base = sorted(map(str, rows(derived.sessions)))
    for n in (1, 37):
        again = build_sessions(spread(derived.api_requests, n), spread(derived.user_prompts, n),
                               spread(derived.tool_events, n))
        assert sorted(map(str, rows(again))) == base


def test_minutes_round_half_up(spark):
    df = spark.createDataFrame([(at("2024-01-01 00:00:00"), at("2024-01-01 00:00:00.300")),
                                (at("2024-01-01 00:00:00"), at("2024-01-01 00:00:00.299"))],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(minutes_between(F.col("a"), F.col("b"))).collect()]
    assert got == [0.01, 0.0]


def test_week_labels_match_strftime(spark):
    days = spark.sql("SELECT explode(sequence(date'1999-12-25', date'2032-01-10')) AS d")
    bad = [r for r in days.select("d", week_label(F.col("d")).alias("w")).collect()
           if r["d"].strftime("%Y-W%W") != r["w"]]
    assert not bad


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], "k string, v int, t string")
    got = {r["k"]: r["t"] for r in rows(upsert_latest(old, new, ["k"], "v"))}
    assert got == {"a": "z", "b": "y", "c": "w"}


def test_builders_agree(spark):
    assert sessions(spark, [("a@x", "2024-01-01")]).count() == 1
    assert table(spark, "employees", [{"email": "a@x"}]).first()["practice"] == "Data"
