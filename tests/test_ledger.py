import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from helpers import fails

from tablesync import stored_table
from tablesync.functions import EPOCH, ntz
from tablesync.operators import (
    active_locks,
    due_accounts,
    due_users,
    ledger_write,
    lock_check,
    lock_conflicts,
    lock_staleness,
    log_retention,
    purge_runs,
    run_errors,
    run_outcome,
    step_order,
)
from tablesync.operators.running import in_ranges, number_rows, running_totals
from tablesync.plans import nightly_maintenance

NOW = datetime(2024, 3, 10, 12)
RUN = "run_id string, name string, user_id string, result string, started_at string, finished_at string"


def runs_frame(spark, data):
    df = spark.createDataFrame(data, RUN)
    for c in ("started_at", "finished_at"):
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@pytest.fixture
def runs(spark):
    return runs_frame(
        spark,
        [
            ("fresh", "ingest", "u", "in_progress", "2024-03-10 11:00:01", EPOCH),
            ("edge", "ingest", "u", "in_progress", "2024-03-10 11:00:00", EPOCH),
            ("nobody", "ingest", None, "in_progress", "2024-03-09 12:00:00", EPOCH),
            ("old", "clean", None, "in_progress", "2024-03-09 11:59:59", EPOCH),
            ("done", "ingest", "u", "success", "2024-03-01 00:00:00", "2024-03-01 00:00:05"),
        ],
    )


def test_active_locks_are_null_safe(spark, rows, runs):
    assert rows(active_locks(runs), "run_id") == [("edge",), ("fresh",), ("nobody",), ("old",)]
    assert rows(active_locks(runs, name="ingest"), "run_id") == [("nobody",)]
    assert rows(active_locks(runs, name="ingest", user_id="u"), "run_id") == [("edge",), ("fresh",)]
    asked = spark.createDataFrame([("clean", None), ("clean", "u"), ("none", None)], "name string, user_id string")
    assert rows(active_locks(runs, asked), "run_id") == [("old",)]


def test_staleness_at_the_cut_off(rows, runs):
    assert rows(lock_staleness(runs, NOW), "run_id", "lock") == [
        ("edge", "stale"),
        ("fresh", "fresh"),
        ("nobody", "stale"),
        ("old", "stale"),
    ]
    wide = lock_staleness(runs, NOW, timedelta(days=2))
    assert {r.lock for r in wide.collect()} == {"fresh"}


def test_a_second_run_is_blocked_until_the_lock_is_stale(spark, rows, runs):
    asked = spark.createDataFrame(
        [("ingest", "u"), ("ingest", None), ("ingest", "v"), ("ingest", "u")], "name string, user_id string"
    )
    assert rows(lock_check(runs, asked, NOW)) == [
        ("ingest", None, "stale", None),
        ("ingest", "u", "blocked", datetime(2024, 3, 10, 11, 0, 1)),
        ("ingest", "v", "free", None),
    ]
    later = lock_check(runs, asked, NOW + timedelta(seconds=1))
    assert rows(later, "user_id", "status") == [(None, "stale"), ("u", "stale"), ("v", "free")]


def test_purge_is_strict_about_the_cut_off(rows, runs):
    done = purge_runs(runs, NOW)
    assert rows(done.next_state, "run_id") == [("done",), ("edge",), ("fresh",), ("nobody",)]
    assert done.metrics.first().rows_deleted == 1


def test_outcomes_and_errors(spark, rows):
    steps = spark.createDataFrame(
        [
            ("a", 0, "x", True, "success", None),
            ("b", 0, "x", False, "failure", "boom"),
            ("b", 1, "y", True, "success", ""),
            ("c", 0, "x", False, "failure", "one"),
            ("c", 1, "y", True, "failure", "two"),
            ("d", 0, "x", None, "failure", None),
        ],
        "run_id string, step_order int, name string, critical boolean, result string, error_message string",
    )
    assert rows(run_outcome(steps)) == [("a", "success"), ("b", "partial"), ("c", "failure"), ("d", "failure")]
    assert rows(run_errors(steps)) == [("b", 0, "x: boom"), ("c", 0, "x: one"), ("c", 1, "y: two")]


@pytest.mark.parametrize(
    "options",
    [{}, {"parts": 1}, {"parts": 20}],
)
def test_step_order(spark, options):
    start = datetime(2024, 3, 10, 1, 59)
    data = [(f"r{i % 3}", start + timedelta(seconds=(i * 37) % 400), i) for i in range(300)]
    df = spark.createDataFrame(data, "run_id string, started_at timestamp_ntz, id int")
    got = {(r.run_id, r.id): r.step_order for r in step_order(df, ["id"], **options).collect()}
    want = {}
    for run in ("r0", "r1", "r2"):
        for position, (_, _, i) in enumerate(sorted(d for d in data if d[0] == run)):
            want[run, i] = position
    assert got == want


def test_steps_of_one_instant_are_spread(spark):
    """One run, one instant: the ties cut it into ranges, none of them large."""
    steps = spark.range(20_000).select(
        F.lit("r").alias("run_id"), F.lit(NOW).cast("timestamp_ntz").alias("started_at"), F.col("id").alias("name")
    )
    laid = in_ranges(steps, ["run_id"], ["started_at", "name"], parts=16)
    sizes = [r["count"] for r in laid.groupBy("_part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 5_000
    assert step_order(steps, parts=16).where("step_order <> name").isEmpty()


def test_running_totals_with_null_group_and_ties(spark):
    data = [(None if i % 3 == 0 else f"g{i % 3}", i // 4, i, None if i % 7 == 0 else i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, t int, id int, v int")
    got = {r.id: (r.total, r.n) for r in running_totals(df, ["g"], ["t", "id"], {"total": F.col("v"), "n": F.lit(1)}, 7).collect()}
    for g, t, i, _ in data:
        upto = [d for d in data if d[0] == g and (d[1], d[2]) <= (t, i)]
        assert got[i] == (sum(d[3] or 0 for d in upto), len(upto))


def test_lock_conflicts_against_all_pairs(spark):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(250):
        at = start + timedelta(minutes=rng.randrange(3000))
        end = rng.choice([at + timedelta(minutes=rng.randrange(90)), at + timedelta(minutes=rng.randrange(300)), datetime(1970, 1, 1)])
        data.append((f"r{i:03}", rng.choice(["a", "a", "a", "b"]), rng.choice([None, "u", "v"]), at, end))
    df = spark.createDataFrame(data, "run_id string, name string, user_id string, started_at timestamp_ntz, finished_at timestamp_ntz")
    now = start + timedelta(minutes=2500)
    until = lambda r: min(now if r[4].year == 1970 else r[4], r[3] + timedelta(hours=1))
    want = []
    for b in data:
        held = [(until(a), a[0]) for a in data if a[1:3] == b[1:3] and (a[3], a[0]) < (b[3], b[0]) and until(a) > b[3]]
        if held:
            want.append((*b[:4], *max(held)))
    assert len(want) > 20
    assert sorted(map(tuple, lock_conflicts(df, now).collect())) == sorted(want)
    assert lock_conflicts(df.limit(0), now).collect() == []


def test_running_totals_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, t int")
    assert running_totals(df, ["g"], ["t"], {"n": F.lit(1)}).collect() == []
    assert number_rows(df, ["g"], ["t"], "n").collect() == []


@pytest.mark.parametrize("parts", [1, 20])
def test_step_without_run_or_time_fails(spark, parts):
    df = spark.createDataFrame([(None, NOW, 1)], "run_id string, started_at timestamp_ntz, id int")
    with fails("run_id is NULL"):
        step_order(df, ["id"], parts=parts).collect()


def test_ledger_write_replaces_the_placeholder(spark, rows, runs):
    finished = runs.where("run_id = 'fresh'").withColumn("result", F.lit("partial")).withColumn("finished_at", ntz(NOW))
    steps_contract = stored_table("pipeline_run_steps")
    steps = spark.createDataFrame(
        [("fresh", i, f"s{i}", "success", NOW, NOW, None) for i in range(2)], steps_contract.struct()
    )
    empty = spark.createDataFrame([], steps_contract.struct())
    run_write, step_write = ledger_write(runs, empty, finished, steps, stored_table("pipeline_runs"), steps_contract)
    state = {r.run_id: (r.result, r.finished_at) for r in run_write.next_state.collect()}
    assert len(state) == 5 and state["fresh"] == ("partial", NOW)
    assert active_locks(run_write.next_state).count() == 3
    assert rows(step_write.next_state, "run_id", "step_order") == [("fresh", 0), ("fresh", 1)]
    again = ledger_write(
        run_write.next_state, step_write.next_state, finished, steps, stored_table("pipeline_runs"), steps_contract
    )
    assert rows(again[1].next_state) == rows(step_write.next_state)


def test_due_accounts(spark, rows):
    df = spark.createDataFrame(
        [("never", None), ("edge", NOW - timedelta(hours=24)), ("recent", NOW - timedelta(hours=23))],
        "account_id string, latest_ingestion timestamp_ntz",
    )
    assert rows(due_accounts(df, NOW), "account_id") == [("edge",), ("never",)]


def test_due_users_over_local_midnight(spark, rows):
    df = spark.createDataFrame(
        [
            ("ams", "03:00:00", "Europe/Amsterdam"),  # 01:00 UTC in summer
            ("nyc", "23:15:00", "America/New_York"),  # 03:15 UTC the next day
            ("tok", "00:30:00", "Asia/Tokyo"),  # 15:30 UTC the day before
            ("bad", "00:00:00", "Mars/Olympus"),
        ],
        "user_id string, cron_time string, timezone string",
    )
    due = due_users(df, datetime(2024, 7, 1), datetime(2024, 7, 2))
    assert rows(due.select("user_id", F.col("due_at").cast("string"))) == [
        ("ams", "2024-07-01 01:00:00"),
        ("nyc", "2024-07-01 03:15:00"),
        ("tok", "2024-07-01 15:30:00"),
    ]
    narrow = due_users(df, datetime(2024, 7, 1, 1), datetime(2024, 7, 1, 3, 15))
    assert rows(narrow, "user_id") == [("ams",)]


def test_retention_and_nightly(spark, rows, runs):
    logs = spark.createDataFrame(
        [(1, NOW - timedelta(days=30)), (2, NOW - timedelta(days=30, microseconds=1))], "log_id int, ts timestamp_ntz"
    )
    assert rows(log_retention(logs, NOW), "log_id") == [(1,)]
    dated = logs.withColumn("day", F.col("ts").cast("date"))
    assert rows(log_retention(dated, NOW, day="day"), "log_id") == [(1,)]
    bridge = spark.createDataFrame([("u", "a"), ("u", "gone")], "user_id string, account_id string")
    accounts = spark.createDataFrame([("a",), ("b",)], "account_id string")
    night = nightly_maintenance(runs, bridge, accounts, logs, NOW)
    assert night.runs.next_state.count() == 4
    assert rows(night.links) == [("u", "a")]
    assert rows(night.orphans) == [("b",)]
    assert night.logs.count() == 1
