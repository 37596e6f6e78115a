"""The stored warehouse: load, open, scan."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallywing.model import EVENT_KINDS, UNKNOWN_KIND, Warehouse
from tallywing.operators.quality import request_aggregates
from tallywing.operators.sessions import build_sessions
from tallywing.session import require_utc
from tallywing.sources.directory import read_employees
from tallywing.sources.envelopes import (
    TABLE_KINDS, parse_events, read_lines, table_columns, typed_events)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored frame, or none where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if (problem.getCondition() or "") in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def event_tables(stored: DataFrame) -> dict[str, DataFrame]:
    """The four event tables as views of the stored frame; kinds prune to their folders."""
    return {
        table: stored.where(F.col("kind").isin(kinds)).select(*table_columns(kinds[0]))
        for table, kinds in TABLE_KINDS.items()
    }


def current_folder(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest finished load."""
    loads = existing(spark, f"{root}/loads")
    newest = loads.orderBy(F.desc("finished"), "folder").first() if loads is not None else None
    return f"{root}/{newest['folder']}" if newest else None


def open_warehouse(spark: SparkSession, root: str, first_day: str | None = None,
                   last_day: str | None = None) -> Warehouse:
    """The tables of the newest finished load.

    Given days, both included, leave events of other days out; only those days' folders are
    read. Sessions that touch the days are kept whole.
    """
    folder = current_folder(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no finished load under {root}")
    events, sessions = (spark.read.parquet(f"{folder}/{t}") for t in ("events", "sessions"))
    if first_day is not None:
        events = events.where(F.col("date") >= F.lit(first_day).cast("date"))
        sessions = sessions.where(F.to_date("end_time") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        events = events.where(F.col("date") <= F.lit(last_day).cast("date"))
        sessions = sessions.where(F.to_date("start_time") <= F.lit(last_day).cast("date"))
    return Warehouse(employees=spark.read.parquet(f"{folder}/employees"), sessions=sessions,
                     **event_tables(events))


def load_counters(spark: SparkSession, root: str) -> DataFrame | None:
    """What the newest finished load counted in request rows on the way, for ``quality_report``.

    One row with the columns of ``request_counters``; none for loads made before loads counted.
    """
    folder = current_folder(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no finished load under {root}")
    return existing(spark, f"{folder}/counters")


def _is_loaded(spark: SparkSession, root: str) -> bool:
    folder = current_folder(spark, root)
    if folder is None:
        return False
    events = spark.read.parquet(f"{folder}/events")
    return not events.where(F.col("kind") == "api_request").isEmpty()


def load_warehouse(spark: SparkSession, events_path: str, employees_path: str, root: str,
                   force: bool = False) -> tuple[Warehouse, dict[str, int]]:
    """Build the warehouse under ``root`` and count the events per kind on the way.

    Skipped where request rows are already stored, unless ``force``. A load writes a folder
    of its own and is entered in ``loads`` when all tables are complete; until then readers
    see the load before it. Events are stored once, partitioned by kind and date.
    Counters are observed on the write itself; a skipped load has none. Those of the quality
    checks are stored with the load (:func:`load_counters`).
    """
    require_utc(spark)
    if not force and _is_loaded(spark, root):
        return open_warehouse(spark, root), {}
    folder = f"{root}/load-{uuid.uuid4().hex}"
    try:
        lines = read_lines(spark, events_path)
        employees = read_employees(spark, employees_path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in (problem.getCondition() or ""):
            raise FileNotFoundError(str(problem)) from problem
        raise
    kinds = [*EVENT_KINDS.values(), UNKNOWN_KIND]
    loaded = Observation("loaded")
    events = parse_events(lines).observe(
        loaded, *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
        F.count(F.lit(1)).alias("total"))
    # Rebalancing gives each folder few files of even size and splits a day that is much
    # larger than the others. Counters for the quality checks are observed behind it: a
    # writing task counts once, while tasks before a shuffle may be run again.
    typed = typed_events(events).hint("rebalance", "kind", "date")
    counted = Observation("requests")
    typed.observe(counted, *request_aggregates(dict(typed.dtypes), F.col("kind") == "api_request")).write.partitionBy(
        "kind", "date").parquet(f"{folder}/events")
    counters = counted.get
    spark.createDataFrame([tuple(counters.values())], ", ".join(
        f"{n} {'double' if n.startswith(('mean_', 'dev_')) else 'bigint'}" for n in counters)
    ).write.parquet(f"{folder}/counters")
    employees.write.parquet(f"{folder}/employees")
    tables = event_tables(spark.read.parquet(f"{folder}/events"))
    build_sessions(tables["api_requests"], tables["user_prompts"], tables["tool_events"]
                   ).write.parquet(f"{folder}/sessions")
    spark.range(1).select(F.lit(folder.rsplit("/", 1)[1]).alias("folder"),
                          F.current_timestamp().alias("finished")).write.mode("append").parquet(f"{root}/loads")
    return open_warehouse(spark, root), loaded.get


def scan_table(wh: Warehouse, sql: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run SQL over the six tables, written ``{api_requests}`` and so on.

    ``args`` are bound as ``:name`` parameters. No view stays behind in the session.
    """
    return wh.sessions.sparkSession.sql(sql, args=dict(args or {}), **dict(wh.items()))
