"""Tool analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywing.functions.numeric import mean, pct, rounded
from tallywing.model import Warehouse
from tallywing.operators.common import with_employee


def is_decision() -> Column:
    return F.col("event_type") == "decision"


def is_result() -> Column:
    return F.col("event_type") == "result"


def is_accepted() -> Column:
    return is_decision() & (F.col("decision") == "accept")


def is_success() -> Column:
    return is_result() & (F.col("success") == 1)


def tool_usage_summary(wh: Warehouse) -> DataFrame:
    """Decisions, executions, success rate and duration per tool.

    The rate is over all executions, also where a tool ran exactly once; it is null
    for a tool that never ran.
    """
    ran, worked = F.count_if(is_result()), F.count_if(is_success())
    return (wh.tool_events.groupBy("tool_name").agg(
        F.count_if(is_decision()).alias("decisions"),
        F.count_if(is_accepted()).alias("accepted"),
        F.count_if(is_decision() & (F.col("decision") == "reject")).alias("rejected"),
        ran.alias("executions"),
        worked.alias("successes"),
        pct(worked, ran).alias("success_rate_pct"),
        rounded(mean(F.when(is_result(), F.col("duration_ms"))) / 1000, 2).alias("avg_duration_s"),
    ).orderBy(F.desc("decisions"), "tool_name"))


def timed_tools(wh: Warehouse) -> DataFrame:
    """Tools that ran at least once, slowest first."""
    return (tool_usage_summary(wh).where(F.col("avg_duration_s").isNotNull())
            .select("tool_name", "executions", "avg_duration_s")
            .orderBy(F.desc("avg_duration_s"), "tool_name"))


def tool_usage_by_practice(wh: Warehouse) -> DataFrame:
    """Accepted decisions per practice and tool."""
    per_user = wh.tool_events.where(is_accepted()).groupBy("user_email", "tool_name").agg(
        F.count(F.lit(1)).alias("uses"))
    return (with_employee(per_user, wh, "practice").groupBy("practice", "tool_name")
            .agg(F.sum("uses").alias("uses"))
            .orderBy("practice", F.desc("uses"), "tool_name"))


def tool_practice_pivot(wh: Warehouse, tools: list[str] | None = None) -> DataFrame:
    """Practice × tool matrix of uses, 0 where unused.

    Without ``tools`` the column list is read from the data, which costs a job.
    """
    cells = tool_usage_by_practice(wh).groupBy("practice")
    wide = cells.pivot("tool_name", tools) if tools else cells.pivot("tool_name")
    return wide.agg(F.sum("uses")).na.fill(0).orderBy("practice")


def tool_decision_sources(wh: Warehouse) -> DataFrame:
    return (wh.tool_events.where(is_decision()).groupBy("source")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "source"))


ALL_PRACTICES = "All"


def tool_adoption_over_time(wh: Warehouse) -> DataFrame:
    """Cumulative number of distinct tools accepted, per day, overall and per practice.

    A tool counts from its first day on. The facts are folded to one row per user,
    tool and day, then to first days, so the running sum is over days only.
    """
    days = wh.tool_events.where(is_accepted()).select(
        "user_email", "tool_name", F.to_date("timestamp").alias("date")).distinct()
    days = with_employee(days, wh, "practice").select("practice", "tool_name", "date").distinct()
    scoped = days.unionByName(days.withColumn("practice", F.lit(ALL_PRACTICES)))
    new_tools = (scoped.groupBy("practice", "tool_name").agg(F.min("date").alias("date"))
                 .groupBy("practice", "date").agg(F.count(F.lit(1)).alias("new")))
    active = scoped.groupBy("practice", "date").agg(F.lit(0).cast("bigint").alias("new"))
    growth = (active.unionByName(new_tools).groupBy("practice", "date")
              .agg(F.sum("new").alias("new")))
    upto = Window.partitionBy("practice").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return growth.select("date", "practice",
                         F.sum("new").over(upto).alias("cumulative_tools")
                         ).orderBy("practice", "date")
