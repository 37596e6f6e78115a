"""Sessionisation and latest-wins upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.functions.timeparts import minutes_between
from tallywing.session import require_utc


COUNTERS = ["turns", "calls", "decisions", "cost", "tokens"]
#: Silence that ends a session where events carry no session id.
GAP_SECONDS = 1800


def session_facts(api_requests: DataFrame, user_prompts: DataFrame,
                  tool_events: DataFrame) -> DataFrame:
    """Requests, prompts and tool events as one narrow frame of counters.

    Errors do not take part. The frames may be streaming.
    """
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    no_cost = F.lit(None).cast(api_requests.schema["cost_usd"].dataType)

    def facts(df: DataFrame, **measures: Column) -> DataFrame:
        cols = dict.fromkeys(COUNTERS, none) | {"cost": no_cost} | measures
        return df.select("session_id", "user_email", F.col("timestamp").alias("ts"),
                         *[c.alias(name) for name, c in cols.items()])

    decided = F.when(F.col("event_type") == "decision", one).otherwise(none)
    return (facts(api_requests, calls=one, tokens=F.col("total_tokens"), cost=F.col("cost_usd"))
            .unionByName(facts(user_prompts, turns=one))
            .unionByName(facts(tool_events, decisions=decided)))


def event_facts(events: DataFrame) -> DataFrame:
    """``session_facts`` of one frame of events with their ``kind``, in a single scan."""
    def one(*kinds: str) -> Column:
        return F.when(F.col("kind").isin(*kinds), F.lit(1)).otherwise(0).cast("bigint")

    kinds = {"turns": "user_prompt", "calls": "api_request", "decisions": "tool_decision"}
    return events.where(F.col("kind").isin(*kinds.values(), "tool_result")).select(
        "session_id", "user_email", F.col("timestamp").alias("ts"),
        *[one(kind).alias(name) for name, kind in kinds.items()],
        F.when(F.col("kind") == "api_request", F.col("cost_usd")).alias("cost"),
        F.when(F.col("kind") == "api_request", F.col("total_tokens")).otherwise(0).alias("tokens"))


def fold_facts(facts: DataFrame, *extra: Column | str) -> DataFrame:
    """Facts summed per (session, email) and ``extra`` keys, with first and last instant."""
    return facts.groupBy("session_id", "user_email", *extra).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"),
        *[F.sum(c).alias(c) for c in COUNTERS])


def fold_sessions(per_email: DataFrame) -> DataFrame:
    """One row per session from one row per (session, email).

    Counters cover the whole session; a session seen under several emails keeps the
    greatest email and that email's own first and last event.
    """
    seen = F.max_by(F.struct("first", "last"), "user_email")
    folded = per_email.groupBy("session_id").agg(
        F.max("user_email").alias("user_email"), seen.alias("seen"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])
    first, last = F.col("seen.first"), F.col("seen.last")
    return folded.select(
        "session_id", "user_email",
        first.alias("start_time"), last.alias("end_time"),
        minutes_between(first, last).alias("duration_min"),
        F.col("turns").alias("num_turns"),
        F.col("calls").alias("num_api_calls"),
        F.col("decisions").alias("num_tool_calls"),
        F.col("cost").alias("total_cost_usd"),
        F.col("tokens").alias("total_tokens"),
    )


def build_sessions(api_requests: DataFrame, user_prompts: DataFrame,
                   tool_events: DataFrame) -> DataFrame:
    """One row per session over requests, prompts and tool events.

    The three tables flow through one aggregation whose map side folds a session's
    events before anything is shuffled; the second, by session, sees a row per email.
    """
    return fold_sessions(fold_facts(session_facts(api_requests, user_prompts, tool_events)))


def gap_session_rows(folded: DataFrame) -> DataFrame:
    """Columns of a gap session from one row per session with first and last instant."""
    first, last = (F.col(c).cast("timestamp_ntz") for c in ("first", "last"))
    return folded.select(
        "user_email", first.alias("start_time"), last.alias("end_time"),
        minutes_between(first, last).alias("duration_min"),
        F.coalesce("turns", F.lit(0)).alias("num_turns"), F.coalesce("calls", F.lit(0)).alias("num_api_calls"),
        F.coalesce("decisions", F.lit(0)).alias("num_tool_calls"),
        F.coalesce("cost", F.lit(0)).alias("total_cost_usd"), F.coalesce("tokens", F.lit(0)).alias("total_tokens"))


def gap_sessions(facts: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Sessions of ``session_facts`` without session ids: a user's events up to a silence of
    more than ``gap_seconds``. Facts without an instant belong to none; a null user is a user.

    Events in one slot as long as the gap are always of one session, so a user's events fold
    per slot before the shuffle; what a session window merges is a row per slot.
    """
    require_utc(facts.sparkSession)
    timed = facts.withColumn("ts", F.col("ts").cast("timestamp"))
    slots = timed.groupBy("user_email", F.window("ts", f"{gap_seconds} seconds").alias("slot")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), *[F.sum(c).alias(c) for c in COUNTERS])
    span = ((F.unix_micros("last") - F.unix_micros("first")) / 1_000_000).cast("decimal(18,6)") + gap_seconds
    return gap_session_rows(slots.groupBy("user_email", F.session_window(
        F.col("first"), F.make_interval(secs=span)).alias("w")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in COUNTERS]))


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: Sequence[str],
                  version: str) -> DataFrame:
    """Rows of both frames, the one with the greatest ``version`` per key.

    ``max_by`` folds copies before the shuffle, so many versions of one key never
    meet in a single task as a window partition would make them.
    """
    rows = current.unionByName(incoming)
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return (rows.groupBy(*keys).agg(F.max_by(whole, F.col(version)).alias("_row"))
            .select("_row.*"))
