"""Events stored by session, so that work per session needs no shuffle.

Beside the events of a load, which lie by kind and day, the few columns that sessions and
their checks read are stored once more in buckets of the session id; the sessions made from
them lie in the same buckets. Sessions, the window check and the prompt check then read
bucket by bucket and join without an exchange of events.

A bucket is one task's work. Sessions with more events than an average bucket, fewer than
there are buckets, are therefore stored apart, without buckets: their events are folded
before a shuffle, as in any other load. A session lies whole in one of the two parts, the
events without a session id as well.

Bucketed scans must not be united: Spark 4.1 takes a union of scans with equal buckets for
partitioned by the bucket key, but appends their partitions when it reads columns in
batches, so a grouping above it returns a group several times. All kinds of events therefore
lie in one table, and the parts are only joined up after they have been aggregated.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallywing.model import TABLES, Warehouse
from tallywing.operators.sessions import event_facts, fold_facts, fold_sessions
from tallywing.session import materialize
from tallywing.sources.envelopes import TABLE_KINDS
from tallywing.sources.warehouse import current_folder, existing, open_warehouse

COLUMNS = ["kind", "session_id", "user_email", "timestamp", "cost_usd", "total_tokens"]


@dataclass(frozen=True)
class SessionWarehouse(Warehouse):
    """A warehouse whose session checks read ``parts``, the tables stored by session.

    The parts hold the columns that sessions and their checks need, not whole rows."""

    parts: tuple[Warehouse, ...] = ()

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((name, getattr(self, name)) for name in TABLES)


def sessions_of(events: DataFrame) -> DataFrame:
    """One row per session from one frame of events; shuffles nothing if it is stored by session."""
    return fold_sessions(fold_facts(event_facts(events)))


def _write(df: DataFrame, path: str, buckets: int, *order: str) -> None:
    """Stores ``df``, partitioned by session already, one file per bucket."""
    name = f"tallywing_{uuid.uuid4().hex}"
    try:
        df.write.format("parquet").bucketBy(buckets, "session_id").sortBy(*order, "session_id").option(
            "path", path).saveAsTable(name)
    finally:
        # A table with a path of its own leaves its files in place.
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _read(spark: SparkSession, path: str, buckets: int, schema: StructType) -> DataFrame:
    """The bucketed table at ``path``. Its entry in the catalogue is needed only to plan the scan."""
    name = f"tallywing_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (session_id) "
              f"INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def busy_sessions(events: DataFrame, buckets: int) -> DataFrame:
    """Sessions with more events than an average bucket; there are fewer than ``buckets``."""
    sizes = materialize(events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")), "session-sizes")
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.where(F.col("n") * buckets > total).select(F.col("session_id").alias("_busy"))


def store_by_session(spark: SparkSession, root: str, buckets: int | None = None) -> None:
    """Stores events and sessions of the newest finished load by session.

    ``buckets`` (default: the number of shuffle partitions) should make a bucket of ``COLUMNS``
    some hundred megabytes. The copy is entered in a list when complete; the newest entry counts.
    ``root`` has to be absolute, because a table's path is not looked up in the working folder.
    """
    if "://" not in root and not root.startswith(("/", "file:")):
        raise ValueError(f"not an absolute path: {root}")
    folder = current_folder(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no finished load under {root}")
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"by-session-{uuid.uuid4().hex}"
    place = f"{folder}/{name}"
    events = spark.read.parquet(f"{folder}/events").select(*COLUMNS)
    # Fewer rows than buckets, so they may be sent to every task.
    busy = F.broadcast(materialize(busy_sessions(events, buckets), "busy-sessions"))
    is_busy = F.col("session_id").eqNullSafe(F.col("_busy"))
    quiet = events.join(busy, is_busy, "left_anti")
    _write(quiet.repartition(buckets, "session_id"), f"{place}/quiet-events", buckets, "kind")
    events.join(busy, is_busy, "left_semi").write.parquet(f"{place}/busy-events")
    quiet_stored = _read(spark, f"{place}/quiet-events", buckets, events.schema)
    _write(sessions_of(quiet_stored), f"{place}/quiet-sessions", buckets)
    busy_stored = spark.read.schema(events.schema).parquet(f"{place}/busy-events")
    sessions_of(busy_stored).write.parquet(f"{place}/busy-sessions")
    spark.range(1).select(F.lit(name).alias("name"), F.lit(buckets).alias("buckets"),
                          F.current_timestamp().alias("finished")).write.mode("append").parquet(f"{folder}/by-session")


def open_by_session(spark: SparkSession, root: str) -> SessionWarehouse:
    """The newest finished load with its tables by session; ``sessions`` are those stored by session."""
    folder = current_folder(spark, root)
    stored = existing(spark, f"{folder}/by-session") if folder else None
    newest = stored.orderBy(F.desc("finished"), "name").first() if stored is not None else None
    if newest is None:
        raise FileNotFoundError(f"no load stored by session under {root}")
    place, buckets = f"{folder}/{newest['name']}", newest["buckets"]
    whole = open_warehouse(spark, root)
    events_schema = spark.read.parquet(f"{folder}/events").select(*COLUMNS).schema

    def part(events: DataFrame, sessions: DataFrame) -> Warehouse:
        tables = {table: events.where(F.col("kind").isin(kinds)) for table, kinds in TABLE_KINDS.items()}
        return Warehouse(employees=whole.employees, sessions=sessions, **tables)

    session_schema = whole.sessions.schema
    quiet = part(_read(spark, f"{place}/quiet-events", buckets, events_schema),
                 _read(spark, f"{place}/quiet-sessions", buckets, session_schema))
    busy = part(spark.read.schema(events_schema).parquet(f"{place}/busy-events"),
                spark.read.schema(session_schema).parquet(f"{place}/busy-sessions"))
    # Sessions read as plain files may be united with others.
    sessions = spark.read.schema(session_schema).parquet(f"{place}/quiet-sessions", f"{place}/busy-sessions")
    tables = dict(whole.items()) | {"sessions": sessions}
    return SessionWarehouse(**tables, parts=(quiet, busy))
