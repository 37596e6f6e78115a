import pytest
from builders import at, make, rows, sessions

from tallywing.operators import errors, people, prompts, tools, usage


def test_kpis_without_long_sessions_and_calls(spark):
    wh = make(spark, sessions=sessions(spark, [
        {"user_email": "a", "start_time": at("2024-01-01"), "duration_min": 10.0, "num_api_calls": 3},
        {"user_email": "b", "start_time": at("2024-01-01"), "duration_min": 480.0, "num_api_calls": 0},
        {"user_email": "a", "start_time": at("2024-01-02"), "duration_min": None}]),
        api_errors=[{}, {}])
    (kpi,) = rows(usage.kpi_summary(wh))
    assert kpi["total_users"] == 2 and kpi["total_sessions"] == 3
    assert kpi["avg_session_min"] == 10.0 and kpi["avg_api_per_session"] == 1.3
    assert kpi["error_rate_pct"] == 200.0 and kpi["total_api_calls"] == 0
    assert rows(usage.kpi_summary(wh, approx=True))[0]["total_users"] == 2


def test_tool_rate_for_one_and_no_executions(spark):
    wh = make(spark, tool_events=[
        {"tool_name": "once"}, {"tool_name": "once", "event_type": "result", "success": 1,
                                "duration_ms": 1500},
        {"tool_name": "never", "decision": "reject"}])
    got = {r["tool_name"]: r for r in rows(tools.tool_usage_summary(wh))}
    assert got["once"]["success_rate_pct"] == 100.0 and got["once"]["avg_duration_s"] == 1.5
    assert got["never"]["success_rate_pct"] is None and got["never"]["rejected"] == 1
    assert [r["tool_name"] for r in rows(tools.timed_tools(wh))] == ["once"]


def test_tool_pivot_discovers_columns(spark):
    wh = make(spark, employees=[{"email": "a@x"}, {"email": "b@x", "practice": "Web"}],
              tool_events=[{"tool_name": "t1"}, {"tool_name": "t2", "user_email": "b@x"},
                           {"tool_name": "t2", "user_email": "ghost"}])
    assert rows(tools.tool_practice_pivot(wh)) == [
        {"practice": "Data", "t1": 1, "t2": 0}, {"practice": "Web", "t1": 0, "t2": 1}]


def test_adoption_counts_a_tool_once(spark):
    def used(tool, day, user="a@x"):
        return {"tool_name": tool, "timestamp": at(day), "user_email": user}

    wh = make(spark, employees=[{"email": "a@x"}, {"email": "b@x", "practice": "Web"}],
              tool_events=[used("t1", "2024-01-01"), used("t1", "2024-01-02"),
                           used("t2", "2024-01-02"), used("t1", "2024-01-03", "b@x")])
    got = [(str(r["date"])[-2:], r["practice"], r["cumulative_tools"])
           for r in rows(tools.tool_adoption_over_time(wh))]
    assert got == [("01", "All", 1), ("02", "All", 2), ("03", "All", 2),
                   ("01", "Data", 1), ("02", "Data", 2), ("03", "Web", 1)]


def test_fanout_identities(spark, derived):
    everyone = 10**6
    true = {r["user_email"]: r for r in rows(people.top_users(derived, everyone))}
    fan = {r["user_email"]: r for r in rows(people.top_users(derived, everyone, fanout=True))}
    assert set(true) == set(fan)
    for user, row in true.items():
        assert fan[user]["api_calls"] == row["api_calls"] * row["sessions"]
        assert fan[user]["total_cost"] == pytest.approx(row["total_cost"] * row["sessions"], abs=0.01 * row["sessions"])
        assert fan[user]["avg_turns"] == row["avg_turns"]


def test_engagement_is_bounded_and_led_by_the_maxima(spark, derived):
    scores = rows(people.user_engagement_scores(derived))
    assert all(0 <= r["engagement_score"] <= 100 for r in scores)
    assert max(r["sessions_n"] for r in scores) == 1.0
    assert [r["engagement_score"] for r in scores] == sorted(
        (r["engagement_score"] for r in scores), reverse=True)


def test_engagement_of_idle_users_is_zero(spark):
    wh = make(spark, employees=[{"email": "a@x"}], sessions=sessions(spark, [
        {"user_email": "a@x", "start_time": at("2024-01-01"), "num_turns": 0}]))
    (row,) = rows(people.user_engagement_scores(wh))
    assert row["avg_turns_n"] == 0.0 and row["distinct_tools"] == 0
    assert row["engagement_score"] == 40.0


def test_peak_hour_tie_takes_the_smaller(spark):
    wh = make(spark, sessions=sessions(spark, [
        ("a@x", f"2024-01-0{d} {h}:00:00") for d, h in ((1, "09"), (2, "14"), (3, "14"), (6, "09"))]))
    (row,) = rows(people.user_activity_profiles(wh))
    assert row["peak_hour"] == 9 and row["weekend_score"] == 25.0 and row["practice"] is None


def test_practice_summary_counts_idle_staff(spark):
    wh = make(spark, employees=[{"email": "a@x"}, {"email": "idle@x"},
                                {"email": "b@x", "practice": "Web"}],
              sessions=sessions(spark, [("a@x", "2024-01-01"), ("a@x", "2024-01-02")]))
    got = {r["practice"]: r for r in rows(people.practice_summary(wh))}
    assert got["Data"]["headcount"] == 2 and got["Data"]["cost_per_engineer"] == 1.0
    assert got["Web"]["sessions"] == 0 and got["Web"]["total_cost"] is None


def test_drilldown(spark, derived):
    assert people.user_drilldown(derived, "nobody@example.com") == {}
    profile = people.user_drilldown(derived, "user1@example.com")
    assert set(profile) == {"employee", "sessions", "model_mix", "tools", "daily", "errors"}
    (kpi,) = rows(people.drilldown_kpis(derived, "user1@example.com"))
    assert kpi["sessions"] == profile["sessions"].count()
    assert kpi["error_groups"] == profile["errors"].count() <= kpi["errors"]


def test_error_shares_sum_to_100(spark, derived):
    shares = [r["pct"] for r in rows(errors.error_summary(derived))]
    assert sum(shares) == pytest.approx(100, abs=0.05 * len(shares))


def test_median_prompt(spark):
    wh = make(spark, employees=[{"email": "a@x"}], user_prompts=[
        {"prompt_length": n} for n in (1, 2, 10, 1000)])
    (row,) = rows(prompts.prompt_stats_by_practice(wh))
    assert row["median_length"] == 6.0 and row["prompts"] == 4 and row["max_length"] == 1000


def test_efficiency_of_a_single_model_is_neutral(spark):
    wh = make(spark, api_requests=[{}])
    (row,) = rows(usage.model_efficiency_index(wh))
    assert row["efficiency_score"] == 50.0 and row["cache_leverage"] == 0.0


def test_approximate_quantiles_are_close(spark, derived):
    exact = {r["metric"]: r for r in rows(usage.token_distribution(derived))}
    near = {r["metric"]: r for r in rows(usage.token_distribution(derived, approx=True))}
    for metric, row in exact.items():
        assert near[metric]["p50"] == pytest.approx(row["p50"], rel=0.05)
