"""A warehouse that grows: only new files are read, only touched session buckets rewritten.

Under the root lie ``events/part=<part>`` and ``employees/<part>``, a folder per load; ``files``,
the manifest of ingested files with the part that holds them; and ``sessions``, a store of
session fragments in buckets of the session id. A part is committed by its rows in the
manifest, written last as one file; before that no reader sees it and the next load reads its
files again. A load that ends between the manifest and the sessions is completed by the next
one, and readers fold its facts in on the fly. One writer at a time.

The session store keeps what each session did under each email, which later facts add to. A
batch reads and rewrites the buckets it touches, into a folder of its own; the table of
commits says which folder holds a bucket's newest version. Files of other buckets stay as
they are, and a batch that is applied already changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.model import Warehouse
from tallywing.operators.sessions import COUNTERS, fold_facts, fold_sessions, session_facts
from tallywing.session import materialize, require_utc
from tallywing.sources.directory import read_employees
from tallywing.sources.envelopes import parse_events, typed_events
from tallywing.sources.warehouse import event_tables, existing

BUCKETS = 64
#: Paths of new files in one load; more are taken by further loads of the same call.
MAX_FILES = 10_000
_KEYS = ["session_id", "user_email"]


@dataclass(frozen=True)
class Increment:
    """What a load has done: files read, events stored, session buckets rewritten."""

    files: int
    events: int
    buckets: int


# --- sessions in buckets ------------------------------------------------------------


def _bucket(number: int) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(number)).cast("int")


def _fold_fragments(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.groupBy(*_KEYS, *extra).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in COUNTERS])


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    return existing(spark, f"{root}/commits")


def bucket_folders(spark: SparkSession, root: str) -> dict[int, str]:
    """The folder with the newest version of each bucket."""
    commits = _commits(spark, root)
    if commits is None:
        return {}
    newest = commits.where("bucket >= 0").groupBy("bucket").agg(F.max_by("folder", "number").alias("folder"))
    return {r.bucket: f"{root}/{r.folder}/bucket={r.bucket}" for r in newest.collect()}


def applied_batches(spark: SparkSession, root: str) -> set[str]:
    commits = _commits(spark, root)
    return set() if commits is None else {r.batch for r in commits.select("batch").distinct().collect()}


def upsert_sessions(facts: DataFrame, root: str, batch: str, buckets: int = BUCKETS) -> int:
    """Add ``session_facts`` to the store; returns the number of buckets rewritten.

    ``batch`` names the facts: a second call with the same name does nothing. The number of
    buckets is that of the store's first batch.
    """
    spark = facts.sparkSession
    commits = _commits(spark, root)
    number = 0
    if commits is not None:
        if not commits.where(F.col("batch") == batch).isEmpty():
            return 0
        last = commits.agg(F.max("number").alias("number"), F.max("buckets").alias("buckets")).first()
        number, buckets = last.number + 1, last.buckets
    incoming = materialize(fold_facts(facts).withColumn("bucket", _bucket(buckets)), "session-facts")
    touched = sorted(r.bucket for r in incoming.select("bucket").distinct().collect())
    folder = f"version-{uuid.uuid4().hex}"
    if touched:
        known = bucket_folders(spark, root)
        paths = [known[b] for b in touched if b in known]
        rows = incoming
        if paths:
            stored = spark.read.schema(incoming.drop("bucket").schema).parquet(*paths)
            rows = rows.unionByName(stored.withColumn("bucket", _bucket(buckets)))
        # Sums of decimals grow wider; what is stored keeps its type from batch to batch.
        merged = _fold_fragments(rows, "bucket").select(*[F.col(f.name).cast(f.dataType) for f in incoming.schema])
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
    entries = [(number, batch, b, folder, buckets) for b in touched or [-1]]
    spark.createDataFrame(entries, "number int, batch string, bucket int, folder string, buckets int").coalesce(1) \
        .write.mode("append").parquet(f"{root}/commits")
    return len(touched)


def session_fragments(spark: SparkSession, root: str) -> DataFrame | None:
    """What each session did under each email, from the newest version of every bucket."""
    paths = sorted(bucket_folders(spark, root).values())
    return spark.read.parquet(*paths) if paths else None


def stored_sessions(spark: SparkSession, root: str) -> DataFrame:
    fragments = session_fragments(spark, root)
    if fragments is None:
        raise FileNotFoundError(f"no sessions under {root}")
    return fold_sessions(fragments)


# --- files --------------------------------------------------------------------------


def new_files(spark: SparkSession, events_path: str, root: str) -> DataFrame:
    """path, length of files below ``events_path`` that no load has read.

    Files do not change once written: one with another length than when it was read is refused.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(events_path).select("path", "length")
    manifest = existing(spark, f"{root}/files")
    if manifest is None:
        return found
    read = manifest.select("path", F.col("length").alias("known_length"))
    both = found.join(read, "path", "left")
    changed = both.where("length <> known_length").limit(3).collect()
    if changed:
        raise ValueError(f"files have changed since they were loaded: {[r.path for r in changed]}")
    return both.where("known_length IS NULL").select("path", "length")


def _parts(spark: SparkSession, root: str) -> dict[str, int]:
    """Committed parts in order and their numbers of events."""
    manifest = existing(spark, f"{root}/files")
    if manifest is None:
        return {}
    parts = manifest.groupBy("number", "part").agg(F.max("events").alias("events")).orderBy("number").collect()
    return {r.part: r.events for r in parts}


def _events(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{root}/events").parquet(*[f"{root}/events/part={p}" for p in parts])


def _facts(spark: SparkSession, root: str, parts: list[str]) -> DataFrame:
    tables = event_tables(_events(spark, root, parts))
    return session_facts(tables["api_requests"], tables["user_prompts"], tables["tool_events"])


def _pending(spark: SparkSession, root: str) -> list[str]:
    done = applied_batches(spark, f"{root}/sessions")
    return [p for p, events in _parts(spark, root).items() if events and p not in done]


def complete(spark: SparkSession, root: str) -> int:
    """Bring the sessions up to the committed parts; returns the number of buckets rewritten."""
    return sum(upsert_sessions(_facts(spark, root, [p]), f"{root}/sessions", p) for p in _pending(spark, root))


def load_increment(spark: SparkSession, events_path: str, employees_path: str, root: str,
                   max_files: int = MAX_FILES) -> Increment:
    """Load the files that are new below ``events_path`` into the warehouse under ``root``.

    At most ``max_files`` paths go to the driver at a time; a load of more takes several parts.
    """
    require_utc(spark)
    buckets = complete(spark, root)
    files = events = 0
    while True:
        try:
            batch = [(r.path, r.length) for r in new_files(spark, events_path, root).orderBy("path").limit(max_files).collect()]
            employees = read_employees(spark, employees_path)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" in (problem.getCondition() or ""):
                raise FileNotFoundError(str(problem)) from problem
            raise
        if not batch:
            return Increment(files, events, buckets)
        part = uuid.uuid4().hex
        lines = spark.read.text([p for p, _ in batch]).select("value")
        typed_events(parse_events(lines)).hint("rebalance", "kind", "date").write.partitionBy(
            "kind", "date").parquet(f"{root}/events/part={part}")
        employees.write.parquet(f"{root}/employees/{part}")
        stored = existing(spark, f"{root}/events/part={part}")  # none if the files hold no event
        number, found = len(_parts(spark, root)), 0 if stored is None else stored.count()
        spark.createDataFrame([(p, n, part, number, found) for p, n in batch],
                              "path string, length bigint, part string, number int, events bigint") \
            .coalesce(1).write.mode("append").parquet(f"{root}/files")
        events += found
        buckets += complete(spark, root)
        files += len(batch)
        if len(batch) < max_files:
            return Increment(files, events, buckets)


def open_increments(spark: SparkSession, root: str) -> Warehouse:
    """The tables of all committed parts; the newest load's directory."""
    known = _parts(spark, root)
    parts = [p for p, n in known.items() if n]
    if not parts:
        raise FileNotFoundError(f"no load with events under {root}")
    events = _events(spark, root, parts)
    fragments, pending = session_fragments(spark, f"{root}/sessions"), _pending(spark, root)
    if pending:
        missing = fold_facts(_facts(spark, root, pending))
        fragments = missing if fragments is None else _fold_fragments(fragments.unionByName(missing))
    return Warehouse(employees=spark.read.parquet(f"{root}/employees/{[*known][-1]}"), sessions=fold_sessions(fragments),
                     **event_tables(events))
