"""Users, teams and the single-user drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.functions.numeric import mean, pct, ratio, rounded, total
from tallywing.functions.timeparts import weekday_sunday0
from tallywing.model import Warehouse
from tallywing.operators.common import one_row, with_employee
from tallywing.operators.ranking import quantiles
from tallywing.operators.stats import max_normalize, sized
from tallywing.operators.tools import is_decision, is_result


def _sessions_per_user(wh: Warehouse) -> DataFrame:
    return wh.sessions.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("num_turns").alias("turns"),
        F.sum("num_api_calls").alias("calls"),
        F.sum("duration_min").alias("minutes"),
        F.count("duration_min").alias("timed"),
        F.sum("total_cost_usd").alias("cost"),
    )


def top_users(wh: Warehouse, limit: int = 20, fanout: bool = False) -> DataFrame:
    """The ``limit`` users with the highest request cost.

    Requests and sessions are folded per user before they meet, so ``api_calls`` and
    ``total_cost`` are true totals. ``fanout=True`` multiplies both by the user's
    number of sessions, as joining the raw rows on the email would.
    """
    requests = wh.api_requests.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("api_calls"), F.sum("cost_usd").alias("cost"))
    sessions = _sessions_per_user(wh).select(
        "user_email", "sessions",
        rounded(ratio(F.col("turns"), F.col("sessions")), 1).alias("avg_turns"),
        rounded(ratio(F.col("minutes"), F.col("timed")), 1).alias("avg_session_min"))
    users = with_employee(requests.join(sessions, "user_email"), wh,
                          "full_name", "practice", "level", "location")
    times = F.col("sessions") if fanout else F.lit(1).cast("bigint")
    return users.select(
        "user_email", "full_name", "practice", "level", "location", "sessions",
        (F.col("api_calls") * times).alias("api_calls"),
        rounded(F.col("cost") * times, 2).alias("total_cost"),
        "avg_turns", "avg_session_min",
    ).orderBy(F.desc("total_cost"), "user_email").limit(limit)


def _employees_with_sessions(wh: Warehouse, attribute: str) -> DataFrame:
    per_user = _sessions_per_user(wh).withColumnRenamed("user_email", "email")
    return wh.employees.select("email", attribute).join(per_user, "email", "left")


def practice_summary(wh: Warehouse) -> DataFrame:
    """Per practice; users without sessions count in headcount and cost per engineer."""
    staff = _employees_with_sessions(wh, "practice")
    return (staff.groupBy("practice").agg(
        F.count(F.lit(1)).alias("headcount"),
        total(F.col("sessions")).alias("sessions"),
        rounded(F.sum("cost"), 2).alias("total_cost"),
        rounded(ratio(F.sum("turns"), F.sum("sessions")), 1).alias("avg_turns_per_session"),
        rounded(ratio(F.sum("minutes"), F.sum("timed")), 1).alias("avg_session_min"),
        rounded(ratio(F.sum("cost"), F.count(F.lit(1))), 2).alias("cost_per_engineer"),
    ).orderBy(F.desc("total_cost"), "practice"))


def location_summary(wh: Warehouse) -> DataFrame:
    staff = _employees_with_sessions(wh, "location")
    return (staff.groupBy("location").agg(
        F.count(F.lit(1)).alias("engineers"),
        total(F.col("sessions")).alias("sessions"),
        rounded(F.sum("cost"), 2).alias("total_cost"),
        rounded(ratio(F.sum("cost"), F.sum("sessions")), 4).alias("avg_cost_per_session"),
    ).orderBy(F.desc("total_cost"), "location"))


def session_depth_distribution(wh: Warehouse, max_minutes: float = 480) -> DataFrame:
    return wh.sessions.where((F.col("duration_min") < max_minutes) & (F.col("num_turns") > 0)
                             ).select("num_turns", "num_api_calls", "duration_min",
                                      "total_cost_usd")


def session_costs_by_practice(wh: Warehouse) -> DataFrame:
    """One row per session with a cost, by practice."""
    paid = wh.sessions.where(F.col("total_cost_usd") > 0).select("user_email", "total_cost_usd")
    return with_employee(paid, wh, "practice").select("practice", "total_cost_usd")


def all_user_emails(wh: Warehouse) -> DataFrame:
    return wh.employees.select("email").orderBy("email")


def pseudonymize_users(users: DataFrame, column: str = "email") -> DataFrame:
    """Add ``user_id``, the SHA-256 of an address."""
    return users.withColumn("user_id", F.sha2(F.col(column), 256))


def user_engagement_scores(wh: Warehouse, fanout: bool = False) -> DataFrame:
    """Composite of frequency, depth and tool diversity, 0 to 100, highest first.

    A decision's tool is credited to the user of its session. ``fanout=True`` weights
    each session by its number of decisions (at least 1), as averaging over the joined
    session × decision rows would.
    """
    weight: Column = F.greatest(F.lit(1), "num_tool_calls") if fanout else F.lit(1)
    per_user = wh.sessions.groupBy("user_email").agg(
        F.count(F.lit(1)).alias("sessions"),
        rounded(ratio(F.sum(F.col("num_turns") * weight), F.sum(weight)), 2).alias("avg_turns"),
        rounded(F.sum(F.col("total_cost_usd") * weight), 2).alias("total_cost"))
    pairs = wh.tool_events.where(is_decision()).select("session_id", "tool_name").distinct()
    tools = (pairs.join(wh.sessions.select("session_id", "user_email"), "session_id")
             .groupBy("user_email").agg(F.countDistinct("tool_name").alias("distinct_tools")))
    users = with_employee(per_user, wh, "practice", "level", "level_num").join(
        tools, "user_email", "left").na.fill(0, ["distinct_tools"])
    # One row per user, stored: the maxima read it a second time.
    scaled = max_normalize(sized(users), ["sessions", "avg_turns", "distinct_tools"])
    score = (0.40 * F.col("sessions_n") + 0.35 * F.col("avg_turns_n")
             + 0.25 * F.col("distinct_tools_n"))
    return (scaled.withColumn("engagement_score", rounded(100 * score, 1))
            .select("user_email", "practice", "level", "level_num", "sessions", "avg_turns",
                    "total_cost", "distinct_tools", "sessions_n", "avg_turns_n",
                    "distinct_tools_n", "engagement_score")
            .orderBy(F.desc("engagement_score"), "user_email"))


def top_engaged(wh: Warehouse, limit: int = 15) -> DataFrame:
    return user_engagement_scores(wh).select(
        "user_email", "practice", "level", "sessions", "avg_turns", "distinct_tools",
        "total_cost", "engagement_score",
    ).orderBy(F.desc("engagement_score"), "user_email").limit(limit)


def user_activity_profiles(wh: Warehouse) -> DataFrame:
    """Peak hour (the smallest of equal ones) and shares of late, early, weekend starts.

    Count and hour are packed into one number for the maximum, which keeps the
    aggregation hash-based.
    """
    slots = wh.sessions.groupBy(
        "user_email", F.hour("start_time").alias("hour"),
        weekday_sunday0(F.col("start_time")).isin(0, 6).alias("weekend"),
    ).agg(F.count(F.lit(1)).alias("n"))
    hours = slots.groupBy("user_email", "hour").agg(
        F.sum("n").alias("n"), total(F.when(F.col("weekend"), F.col("n"))).alias("weekend"))
    n = F.sum("n")

    def share(rows: Column) -> Column:
        return pct(total(F.when(rows, F.col("n"))), n)

    users = hours.groupBy("user_email").agg(
        n.alias("sessions"),
        (23 - F.max(F.col("n") * 24 + 23 - F.col("hour")) % 24).cast("int").alias("peak_hour"),
        share(F.col("hour") >= 20).alias("night_owl_score"),
        share(F.col("hour") < 8).alias("early_bird_score"),
        pct(F.sum("weekend"), n).alias("weekend_score"))
    return (with_employee(users, wh, "full_name", "practice", "level", how="left")
            .select("user_email", "full_name", "practice", "level", "sessions", "peak_hour",
                    "night_owl_score", "early_bird_score", "weekend_score")
            .orderBy(F.desc("night_owl_score"), "user_email"))


# --- drill-down -------------------------------------------------------------------


def _of(df: DataFrame, email: str, column: str = "user_email") -> DataFrame:
    return df.where(F.col(column) == F.lit(email))


def drilldown_sessions(wh: Warehouse, email: str, limit: int | None = None) -> DataFrame:
    rows = _of(wh.sessions, email).drop("user_email").orderBy(F.desc("start_time"), "session_id")
    return rows.limit(limit) if limit else rows


def drilldown_models(wh: Warehouse, email: str) -> DataFrame:
    return (_of(wh.api_requests, email).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        rounded(F.sum("cost_usd"), 4).alias("cost"),
        F.sum("output_tokens").alias("output_tokens"),
    ).orderBy(F.desc("calls"), "model"))


def drilldown_tools(wh: Warehouse, email: str, limit: int | None = None) -> DataFrame:
    rows = (_of(wh.tool_events, email).where(is_result()).groupBy("tool_name").agg(
        F.count(F.lit(1)).alias("uses"),
        pct(F.sum("success"), F.count(F.lit(1))).alias("success_rate"),
    ).orderBy(F.desc("uses"), "tool_name"))
    return rows.limit(limit) if limit else rows


def drilldown_daily(wh: Warehouse, email: str) -> DataFrame:
    return (_of(wh.sessions, email).groupBy(F.to_date("start_time").alias("date")).agg(
        F.count(F.lit(1)).alias("sessions"),
        rounded(F.sum("total_cost_usd"), 4).alias("cost"),
    ).orderBy("date"))


def drilldown_errors(wh: Warehouse, email: str) -> DataFrame:
    return (_of(wh.api_errors, email).groupBy("error_msg", "status_code")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "error_msg", "status_code"))


def drilldown_kpis(wh: Warehouse, email: str) -> DataFrame:
    """One row of totals; errors both as rows and as (message, status) groups."""
    mine = _of(wh.sessions, email)
    sums = mine.agg(
        F.count(F.lit(1)).alias("sessions"),
        rounded(F.sum("total_cost_usd"), 2).alias("total_cost"),
        F.sum("num_turns").alias("total_turns"),
        rounded(mean(F.col("num_api_calls")), 1).alias("avg_api_per_session"))
    median = quantiles(mine, "duration_min", {"median_session_min": 0.5})
    errors = drilldown_errors(wh, email).agg(
        F.count(F.lit(1)).alias("error_groups"), total(F.col("count")).alias("errors"))
    return one_row(sums, median, errors).withColumn(
        "median_session_min", rounded(F.col("median_session_min"), 1))


def user_drilldown(wh: Warehouse, email: str) -> dict[str, DataFrame]:
    """The profile of one user as lazy frames; empty where the directory has no such user."""
    employee = _of(wh.employees, email, "email")
    if employee.isEmpty():
        return {}
    return {
        "employee": employee,
        "sessions": drilldown_sessions(wh, email),
        "model_mix": drilldown_models(wh, email),
        "tools": drilldown_tools(wh, email),
        "daily": drilldown_daily(wh, email),
        "errors": drilldown_errors(wh, email),
    }


def drilldown_rows(wh: Warehouse, email: str) -> DataFrame:
    """All frames of the drill-down as rows of one, named by ``frame``; other columns are null."""
    frames = [df.withColumn("frame", F.lit(name)) for name, df in user_drilldown(wh, email).items()]
    if not frames:
        raise KeyError(f"no {email} in the directory")
    rows = frames[0]
    for df in frames[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    return rows.select("frame", *[c for c in rows.columns if c != "frame"])
