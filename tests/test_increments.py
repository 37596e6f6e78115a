"""Growing warehouse and session store: several loads equal one."""

import os

import pytest
from builders import at, make, rows
from pyspark.sql import functions as F

from tallywing.operators.sessions import build_sessions, gap_sessions, session_facts
from tallywing.sources import envelopes, increments


def facts_of(wh):
    return session_facts(wh.api_requests, wh.user_prompts, wh.tool_events)


def by_id(frame):
    return {r["session_id"]: {k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()} for r in rows(frame)}


def parquet_files(paths):
    return {os.path.join(p, n) for p in paths for n in os.listdir(p) if n.endswith(".parquet")}


def test_store_in_batches_equals_one_pass(spark, derived, tmp_path):
    root = str(tmp_path / "store")
    facts = facts_of(derived).withColumn("cost", F.col("cost").cast("double"))
    for part in range(3):
        batch = facts.where(F.pmod(F.xxhash64("ts", "session_id"), F.lit(3)) == part)
        assert increments.upsert_sessions(batch, root, f"b{part}", buckets=8) == 8
        assert increments.upsert_sessions(batch, root, f"b{part}", buckets=8) == 0  # replayed
    want = by_id(build_sessions(derived.api_requests, derived.user_prompts, derived.tool_events).withColumn(
        "total_cost_usd", F.col("total_cost_usd").cast("double")))
    assert by_id(increments.stored_sessions(spark, root)) == want


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root = str(tmp_path / "store")
    many = make(spark, api_requests=[{"session_id": f"s{k}", "cost_usd": 0.5} for k in range(200)])
    increments.upsert_sessions(facts_of(many), root, "first", buckets=16)
    before = {b: parquet_files([p]) for b, p in increments.bucket_folders(spark, root).items()}
    one = make(spark, api_requests=[{"session_id": "s7", "timestamp": at("2024-01-01 12:00:00"), "cost_usd": 2.0}])
    # The number of buckets stays that of the first batch.
    assert increments.upsert_sessions(facts_of(one), root, "second", buckets=99) == 1
    after = {b: parquet_files([p]) for b, p in increments.bucket_folders(spark, root).items()}
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    got = by_id(increments.stored_sessions(spark, root))
    assert got["s7"]["num_api_calls"] == 2 and got["s7"]["total_cost_usd"] == 2.5 and got["s7"]["duration_min"] == 120.0
    assert increments.upsert_sessions(facts_of(one).where("false"), root, "nothing") == 0
    assert "nothing" in increments.applied_batches(spark, root) and len(got) == 200


def test_decimals_keep_their_type(spark, derived, tmp_path):
    root = str(tmp_path / "store")
    for batch in range(4):
        increments.upsert_sessions(facts_of(derived).withColumn("cost", F.col("cost").cast("decimal(18,6)")), root, str(batch), 4)
    kinds = dict(increments.session_fragments(spark, root).dtypes)
    assert kinds["cost"] == "decimal(28,6)"


@pytest.fixture
def log_folder(spark, tmp_path):
    staff = tmp_path / "staff.csv"
    staff.write_text("email,full_name,practice,level,location\na@x,A,Data,L1,Here\n")
    logs = str(tmp_path / "logs")

    def write(name, **tables):
        packed = envelopes.pack_envelopes(envelopes.event_messages(make(spark, **tables)), size=3)
        packed.select("value").coalesce(1).write.text(f"{logs}/{name}")
    return logs, str(staff), str(tmp_path / "wh"), write


def test_only_new_files_are_read(spark, log_folder):
    logs, staff, root, write = log_folder
    write("one", api_requests=[{"session_id": "s1"}, {"session_id": "s2"}])
    first = increments.load_increment(spark, logs, staff, root)
    assert (first.files, first.events) == (1, 2) and first.buckets in (1, 2)
    assert increments.load_increment(spark, logs, staff, root) == increments.Increment(0, 0, 0)
    write("two", api_requests=[{"session_id": "s1", "timestamp": at("2024-01-01 11:00:00")}], user_prompts=[{"session_id": "s3"}])
    second = increments.load_increment(spark, logs, staff, root)
    assert (second.files, second.events) == (1, 2)
    wh = increments.open_increments(spark, root)
    assert wh.api_requests.count() == 3 and wh.user_prompts.count() == 1 and wh.employees.count() == 1
    got = by_id(wh.sessions)
    assert got["s1"]["num_api_calls"] == 2 and got["s1"]["duration_min"] == 60.0 and set(got) == {"s1", "s2", "s3"}


def test_many_files_take_several_parts(spark, log_folder):
    logs, staff, root, write = log_folder
    for k in range(5):
        write(str(k), api_requests=[{"session_id": f"s{k % 2}"}])
    done = increments.load_increment(spark, logs, staff, root, max_files=2)
    assert (done.files, done.events) == (5, 5)
    assert {k: v["num_api_calls"] for k, v in by_id(increments.open_increments(spark, root).sessions).items()} == {"s0": 3, "s1": 2}


def test_load_that_ended_before_the_sessions_is_completed(spark, log_folder, monkeypatch):
    logs, staff, root, write = log_folder
    write("one", api_requests=[{"session_id": "s1"}])
    increments.load_increment(spark, logs, staff, root)
    write("two", api_requests=[{"session_id": "s1"}, {"session_id": "s2"}])

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(increments, "upsert_sessions", lost)
        with pytest.raises(RuntimeError):
            increments.load_increment(spark, logs, staff, root)
    # Readers see the part's events, and its sessions folded in.
    wanted = {"s1": 2, "s2": 1}
    assert {k: v["num_api_calls"] for k, v in by_id(increments.open_increments(spark, root).sessions).items()} == wanted
    done = increments.load_increment(spark, logs, staff, root)
    assert done.files == 0 and done.buckets > 0
    assert {k: v["num_api_calls"] for k, v in by_id(increments.stored_sessions(spark, f"{root}/sessions")).items()} == wanted


def test_changed_empty_and_missing_files(spark, log_folder, tmp_path):
    logs, staff, root, write = log_folder
    with pytest.raises(FileNotFoundError):
        increments.load_increment(spark, logs, staff, root)
    os.makedirs(logs)
    log = os.path.join(logs, "a.jsonl")
    with open(log, "w") as f:
        f.write("\n")
    assert increments.load_increment(spark, logs, staff, root).events == 0
    with pytest.raises(FileNotFoundError):
        increments.open_increments(spark, root)
    write("more", api_requests=[{"session_id": "s1"}])
    assert increments.load_increment(spark, logs, staff, root).events == 1
    assert increments.open_increments(spark, root).sessions.count() == 1
    with open(log, "a") as f:
        f.write("{}\n")
    with pytest.raises(ValueError, match="have changed"):
        increments.load_increment(spark, logs, staff, root)


def test_gap_sessions_end_after_more_than_the_gap(spark):
    times = ["10:00:00", "10:20:00", "10:50:00", "11:20:00.001", "13:00:00"]
    wh = make(spark, api_requests=[{"timestamp": at(f"2024-01-01 {t}"), "session_id": None} for t in times]
              + [{"timestamp": at("2024-01-01 10:30:00"), "user_email": "b@x"}, {"timestamp": None, "user_email": "c@x"},
                 {"timestamp": at("2024-01-01 10:00:00"), "user_email": None}])
    got = {(r["user_email"], str(r["start_time"])[11:19]): (r["num_api_calls"], r["duration_min"]) for r in rows(gap_sessions(facts_of(wh)))}
    assert got == {("a@x", "10:00:00"): (3, 50.0), ("a@x", "11:20:00"): (1, 0.0), ("a@x", "13:00:00"): (1, 0.0),
                   ("b@x", "10:30:00"): (1, 0.0), (None, "10:00:00"): (1, 0.0)}


def test_grown_warehouse_packs_once_into_compressed_logs(spark, monkeypatch):
    from tallywing.plans import ingest_queries

    stored, logs = [], set()

    def keep(df, name, kept=ingest_queries.materialize):
        stored.append(name)
        return kept(df, name)

    def load(spark, events_path, *_):
        logs.update(name.rsplit(".", 1)[-1] for _, _, names in os.walk(events_path) for name in names if name.startswith("part"))

    monkeypatch.setattr(ingest_queries, "materialize", keep)
    monkeypatch.setattr(increments, "load_increment", load)
    ingest_queries._grown.__wrapped__(spark, "/root/testdata/sf0.001")
    assert stored == ["packed"] and logs == {"gz"}
