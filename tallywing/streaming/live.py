"""Stateful operators over streams of typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywing.operators.sessions import (
    COUNTERS, GAP_SECONDS, fold_facts, fold_sessions, gap_session_rows as _gap_rows)
from tallywing.session import require_utc


def _with_event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP; the zone-free column is taken as UTC."""
    require_utc(df.sparkSession)
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def stream_dedupe(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First request of each (user, instant, model); copies may come ``delay`` later."""
    return _with_event_time(requests, "timestamp", delay).dropDuplicatesWithinWatermark(
        ["user_email", "timestamp", "model"])


def stream_daily_activity(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per day: calls, cost, tokens, and active users as an estimate and as a sketch.

    Days are tumbling event-time windows whose state goes when the watermark passes. The
    sketches of several days can be merged, the estimates cannot.
    """
    timed = _with_event_time(requests, "timestamp", delay)
    return timed.groupBy(F.window("timestamp", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("api_calls"), F.sum("cost_usd").alias("cost_usd"),
        F.sum("total_tokens").alias("tokens"),
        F.hll_sketch_agg("user_email").alias("users_sketch"),
    ).select(F.to_date("w.start").alias("date"), "api_calls", "cost_usd", "tokens",
             F.hll_sketch_estimate("users_sketch").alias("active_users_approx"), "users_sketch")


def stream_sessions(facts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running session fragments from a stream of ``session_facts``.

    A fragment is what one session did under one email on one day, so state ends with
    the day plus ``delay`` although session ids never expire. Run in update mode and
    fold with :func:`sessions_from_fragments`.
    """
    timed = _with_event_time(facts, "ts", delay)
    return fold_facts(timed, F.window("ts", "1 day").alias("w")).withColumn(
        "day", F.to_date("w.start")).drop("w")


def stream_gap_sessions(facts: DataFrame, gap_seconds: int = GAP_SECONDS, delay: str = "1 day") -> DataFrame:
    """Sessions of a stream of ``session_facts`` without session ids.

    A user's session ends where nothing follows for more than ``gap_seconds``. Run in
    append mode: a session is emitted once, when the watermark has passed its end plus the
    gap, and its state goes. Sessions that are open when the input ends stay in the state.
    Where users are very busy, ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    folds their events before the shuffle.
    """
    timed = _with_event_time(facts, "ts", delay)
    return _gap_rows(timed.groupBy("user_email", F.session_window("ts", f"{gap_seconds} seconds").alias("w")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), *[F.sum(c).alias(c) for c in COUNTERS]))


def store_versions(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every batch of changed rows under its own ``batch=`` folder.

    A batch that is replayed after a failure overwrites its folder, so readers never see
    it twice.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (updates.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_versions(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version per key of what ``store_versions`` wrote."""
    rest = [c for c in stored.columns if c not in (*keys, "batch")]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(
        *keys, "_row.*")


def sessions_from_fragments(stored: DataFrame, late: DataFrame | None = None) -> DataFrame:
    """Sessions from stored fragments of all days, and from fragments of ``late`` facts."""
    fragments = latest_versions(stored, ["session_id", "user_email", "day"])
    if late is not None:
        fragments = fragments.unionByName(late)
    per_email = fragments.groupBy("session_id", "user_email").agg(
        F.min("first").cast("timestamp_ntz").alias("first"),
        F.max("last").cast("timestamp_ntz").alias("last"),
        *[F.sum(c).alias(c) for c in COUNTERS])
    return fold_sessions(per_email)
