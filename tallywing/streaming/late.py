"""Rows behind the watermark: kept, counted and folded in later.

Stateful operators drop rows that come too late, with a counter as the only sign. Here a
stateless stream goes first. It marks the rows that lie behind the watermark and stores
accepted and late rows apart, exactly once; stateful streams read the accepted ones and have
nothing to drop. What the late rows change is added to the streams' results in batch, so that
a batch over all rows equals the stream and its late rows together.

The watermark is the greatest accepted time less ``delay`` and moves between runs: rows that
arrive in one run never make each other late. Streams that read the accepted rows need a delay
of at least this one. A run that is repeated after a failure splits
its rows by what was committed before it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywing.operators.sessions import fold_facts
from tallywing.session import require_utc
from tallywing.sources.warehouse import existing

LATE, DAY = "arrived_late", "arrival_day"


def watermark(spark: SparkSession, path: str, column: str, delay: str) -> datetime | None:
    """The time a row has to lie after now, as Spark counts it; null as long as nothing is stored.

    Only the newest day's files are read for it."""
    stored = existing(spark, path)
    if stored is None:
        return None
    accepted = stored.where(F.col(LATE) == 0)
    newest = accepted.where(F.col(DAY) == accepted.agg(F.max(DAY)).scalar())
    return newest.agg((F.max(column) - F.expr(f"interval {delay}")).alias("mark")).first()["mark"]


def split_late(stream: DataFrame, column: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Store a stream's rows under ``path``, those behind the watermark apart from the others.

    A row without a time is accepted. The query observes ``arrivals``: rows, and late ones.
    Rows are rebalanced by day before they are stored, so files follow days and bytes, not days
    times reading tasks: every later run lists all of them, and listings go to the driver."""
    spark = stream.sparkSession
    require_utc(spark)
    mark = watermark(spark, path, column, delay)
    behind = F.lit(0) if mark is None else F.when(F.col(column) <= F.lit(mark), 1).otherwise(0)
    marked = stream.withColumn(LATE, behind).withColumn(DAY, F.to_date(column)).hint("rebalance", LATE, DAY).observe(
        "arrivals", F.count(F.lit(1)).alias("rows"), F.count_if(F.col(LATE) == 1).alias("late"))
    return (marked.writeStream.format("parquet").partitionBy(LATE, DAY).option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def accepted_stream(spark: SparkSession, path: str) -> DataFrame:
    """The accepted rows as a stream; all files of a run come in one batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).where(F.col(LATE) == 0).drop(LATE, DAY)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col(LATE) == 1).drop(LATE, DAY)


def arrivals(query: StreamingQuery) -> tuple[int, int]:
    """Rows and late rows that a finished ``split_late`` has seen in the batches Spark still reports."""
    seen = [p.observedMetrics["arrivals"] for p in query.recentProgress if "arrivals" in p.observedMetrics]
    return sum(r["rows"] for r in seen), sum(r["late"] for r in seen)


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that stateful operators have dropped in the batches Spark still reports."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def amended_unique(unique: DataFrame, late: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a deduplicating stream and the late ones whose key it has not got."""
    columns = unique.columns
    rows = unique.withColumn("_late", F.lit(0)).unionByName(late.select(columns).withColumn("_late", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    first = F.min_by(F.struct(*rest), "_late").alias("_row") if rest else F.count(F.lit(1)).alias("_row")
    return rows.groupBy(*keys).agg(first).select(*keys, *[f"_row.{c}" for c in rest])


def amended_days(days: DataFrame, late: DataFrame) -> DataFrame:
    """Days of ``stream_daily_activity`` and the late requests: sums, and users from merged sketches."""
    more = late.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count(F.lit(1)).alias("api_calls"), F.sum("cost_usd").alias("cost_usd"), F.sum("total_tokens").alias("tokens"),
        F.hll_sketch_agg("user_email").alias("users_sketch"))
    both = days.select("date", "api_calls", "cost_usd", "tokens", "users_sketch").unionByName(more)
    return both.groupBy("date").agg(
        *[F.sum(c).alias(c) for c in ("api_calls", "cost_usd", "tokens")], F.hll_union_agg("users_sketch").alias("users_sketch")
    ).withColumn("active_users_approx", F.hll_sketch_estimate("users_sketch"))


def late_fragments(late: DataFrame) -> DataFrame:
    """Late ``session_facts`` as fragments, for :func:`live.sessions_from_fragments`."""
    return fold_facts(late, F.to_date("ts").alias("day"))
