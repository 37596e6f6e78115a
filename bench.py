"""Load the warehouse from log files, then time the headline analyses on it.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose data, cores and
the number of warm runs whose median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from tallywing import Warehouse, spark_session  # noqa: E402
from tallywing.model import EMPLOYEE_FIELDS  # noqa: E402
from tallywing.operators import (  # noqa: E402
    behavior, errors, isolation, people, prompts, quality, segments, series, stats, tools, usage)
from tallywing.operators.sessions import build_sessions  # noqa: E402
from tallywing.plans.fixtures import DerivedWarehouse  # noqa: E402
from tallywing.sources import envelopes, warehouse  # noqa: E402

QUERIES: dict[str, Callable[[Warehouse], DataFrame]] = {
    "build_sessions": lambda w: build_sessions(w.api_requests, w.user_prompts, w.tool_events),
    "kpi_summary": usage.kpi_summary,
    "daily_activity": usage.daily_activity,
    "weekly_trend": usage.weekly_trend,
    "cost_by_model": usage.cost_by_model,
    "cost_by_practice": usage.cost_by_practice,
    "token_distribution": usage.token_distribution,
    "model_efficiency_index": usage.model_efficiency_index,
    "tool_usage_summary": tools.tool_usage_summary,
    "tool_adoption_over_time": tools.tool_adoption_over_time,
    "error_summary": errors.error_summary,
    "prompt_stats_by_practice": prompts.prompt_stats_by_practice,
    "top_users": people.top_users,
    "practice_summary": people.practice_summary,
    "user_engagement_scores": people.user_engagement_scores,
    "user_activity_profiles": people.user_activity_profiles,
    "weekly_retention_cohort": behavior.weekly_retention_cohort,
    "session_funnel": behavior.session_funnel,
    "gap_stats_by_practice": behavior.gap_stats_by_practice,
    "forecast_daily_cost": lambda w: series.forecast(usage.daily_activity(w), "cost_usd"),
    "decompose_daily_cost": lambda w: series.decompose(usage.daily_activity(w), "cost_usd"),
    "session_duration_stats": stats.session_duration_stats,
    "cost_anova_by_practice": stats.cost_anova_by_practice,
    "level_cost_correlation": stats.level_cost_correlation,
    "quality_report": quality.quality_report,
    "detect_user_anomalies": isolation.detect_user_anomalies,
    "cluster_users": segments.cluster_users,
}


def drain(df: DataFrame) -> None:
    """Compute every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = spark_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=str(cpus),
        spark__ui__enabled="false", spark__driver__memory=os.environ.get("BENCH_MEM", "5g"))
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="tallywing-bench-")

    derived = DerivedWarehouse(spark, sf_dir)
    packed = envelopes.pack_envelopes(envelopes.event_messages(derived), slot_seconds=3600)
    packed.select("value").repartition(cpus).write.text(f"{root}/logs")
    derived.employees.select(EMPLOYEE_FIELDS).write.csv(f"{root}/staff", header=True)

    def parse() -> None:
        events = envelopes.parse_events(envelopes.read_lines(spark, f"{root}/logs"))
        drain(envelopes.typed_events(events))

    seconds: dict[str, float] = {}

    def timed(name: str, action: Callable[[], object], times: int) -> None:
        spans = []
        for _ in range(times):
            start = time.perf_counter()
            action()
            spans.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(spans), 3)

    parse()
    timed("ingest_parse", parse, runs)
    start = time.perf_counter()
    wh, counts = warehouse.load_warehouse(spark, f"{root}/logs", f"{root}/staff", f"{root}/wh")
    seconds["load_warehouse"] = round(time.perf_counter() - start, 3)
    for name, query in QUERIES.items():
        drain(query(wh))
        timed(name, lambda query=query: drain(query(wh)), runs)
    print(json.dumps({
        "metric": "headline queries on the loaded warehouse, load included",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "events": counts["total"],
        "ingest_events_per_sec": round(counts["total"] / seconds["ingest_parse"]),
        "load_events_per_sec": round(counts["total"] / seconds["load_warehouse"])}))


if __name__ == "__main__":
    main()
