"""Run history: locks, outcomes, errors, clean-up and due work.

"Now" is always an argument, so every result can be reproduced.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.contract import TableContract
from tablesync.functions.keys import null_safe_equal
from tablesync.functions.times import EPOCH, ntz, zoned_to_utc
from tablesync.operators.dedupe import number_in_group
from tablesync.operators.merge import merge
from tablesync.operators.outcome import WriteOutcome
from tablesync.operators.quality import valid_zones
from tablesync.operators.running import highest_before
from tablesync.operators.writes import delete_where

# How long a lock blocks, how long an abandoned run or a log is kept.
LOCK_TIMEOUT = timedelta(hours=1)
PURGE_AFTER = timedelta(days=1)
LOG_RETENTION = timedelta(days=30)
INGEST_EVERY = timedelta(hours=24)


def is_active() -> Column:
    return F.col("finished_at") == ntz(EPOCH)


def ago(now: datetime, span: timedelta) -> Column:
    return ntz(now - span)


def active_locks(
    runs: DataFrame, requests: DataFrame | None = None, *, name: str | None = None, user_id: object = None
) -> DataFrame:
    """Runs that are still active.

    Narrowed to one ``(name, user_id)``, or to the pairs in ``requests``; a NULL
    user is a user like any other.
    """
    active = runs.where(is_active())
    if name is not None:
        active = active.where(null_safe_equal("name", name) & null_safe_equal("user_id", user_id))
    if requests is not None:
        asked = requests.select(F.col("name").alias("_name"), F.col("user_id").alias("_user"))
        same = active["name"].eqNullSafe(asked["_name"]) & active["user_id"].eqNullSafe(asked["_user"])
        active = active.join(asked, same, "left_semi")
    return active


def lock_staleness(runs: DataFrame, now: datetime, timeout: timedelta = LOCK_TIMEOUT) -> DataFrame:
    """Active runs with ``lock``: fresh (blocks a new run) or stale. At the cut-off a lock is stale."""
    fresh = F.col("started_at") > ago(now, timeout)
    return runs.where(is_active()).withColumn("lock", F.when(fresh, "fresh").otherwise("stale"))


def lock_check(
    runs: DataFrame, requests: DataFrame, now: datetime, timeout: timedelta = LOCK_TIMEOUT
) -> DataFrame:
    """What each requested ``(name, user_id)`` would meet: ``status`` is blocked by a fresh
    lock (since ``locked_at``), stale when only abandoned ones are left, or free."""
    fresh = F.col("lock") == "fresh"
    held = (
        lock_staleness(runs, now, timeout)
        .groupBy(F.col("name").alias("_name"), F.col("user_id").alias("_user"))
        .agg(F.min(F.when(fresh, F.col("started_at"))).alias("locked_at"), F.count(F.lit(1)).alias("_locks"))
    )
    asked = requests.select("name", "user_id").distinct()
    same = asked["name"].eqNullSafe(held["_name"]) & asked["user_id"].eqNullSafe(held["_user"])
    status = F.when(F.col("locked_at").isNotNull(), "blocked").when(F.col("_locks") > 0, "stale").otherwise("free")
    return asked.join(held, same, "left").select("name", "user_id", status.alias("status"), "locked_at")


def lock_conflicts(runs: DataFrame, now: datetime, timeout: timedelta = LOCK_TIMEOUT) -> DataFrame:
    """Runs that started while an earlier run of their ``(name, user_id)`` still held the lock, with
    ``held_until`` and ``held_by`` of the one that held it longest.

    A run holds its lock until it finishes, at ``now`` if it is still active, but no longer than ``timeout``: from
    then on it is stale and does not block. Runs of one instant are ordered by ``run_id``. The end that
    counts is a running maximum, so that a lock with any number of runs is cut over many tasks.
    """
    end = F.when(is_active(), ntz(now)).otherwise(F.col("finished_at"))
    until = F.least(end, F.timestamp_add("SECOND", F.lit(int(timeout.total_seconds())), F.col("started_at")))
    held = F.struct(until.alias("until"), F.col("run_id").alias("by"))
    checked = highest_before(runs, ["name", "user_id"], ["started_at", "run_id"], {"_held": held})
    return checked.where(F.col("_held.until") > F.col("started_at")).select(
        "run_id", "name", "user_id", "started_at", F.col("_held.until").alias("held_until"), F.col("_held.by").alias("held_by")
    )


def purge_runs(runs: DataFrame, now: datetime, older_than: timedelta = PURGE_AFTER) -> WriteOutcome:
    """Delete active runs that started before the cut-off."""
    return delete_where(runs, is_active() & (F.col("started_at") < ago(now, older_than)))


def run_outcome(steps: DataFrame) -> DataFrame:
    """One result per run: a failed critical step makes it a failure, any other failed
    step makes it partial. ``critical`` is an input column; a missing value is critical."""
    failed = F.col("result") == "failure"
    critical = F.coalesce(F.col("critical"), F.lit(True))
    rolled = steps.groupBy("run_id").agg(
        F.bool_or(failed & critical).alias("_fatal"), F.bool_or(failed).alias("_failed")
    )
    result = F.when(F.col("_fatal"), "failure").when(F.col("_failed"), "partial").otherwise("success")
    return rolled.select("run_id", result.alias("result"))


def run_errors(steps: DataFrame, order: str = "step_order") -> DataFrame:
    """``step: error`` for every step with an error, with its position in the run.

    The digest of a run is these rows in order. They stay rows, so a run with very
    many errors needs neither a shuffle nor one oversized value.
    """
    message = F.concat(F.col("name"), F.lit(": "), F.col("error_message"))
    return steps.where(F.col("error_message") != "").select("run_id", order, message.alias("error"))


def step_order(steps: DataFrame, tie: Sequence[str] = ("name",), **options: int) -> DataFrame:
    """Zero-based position of each step in its run, by start time."""
    return number_in_group(steps, "run_id", "started_at", tie, alias="step_order", **options)


def ledger_write(
    runs: DataFrame,
    run_steps: DataFrame,
    finished_runs: DataFrame,
    finished_steps: DataFrame,
    runs_contract: TableContract,
    steps_contract: TableContract,
) -> tuple[WriteOutcome, WriteOutcome]:
    """Finish a batch of runs: the result replaces the placeholder row of the run,
    and steps are merged on ``(run_id, step_order)``."""
    return (
        merge(runs, finished_runs, runs_contract),
        merge(run_steps, finished_steps, steps_contract),
    )


def log_retention(logs: DataFrame, now: datetime, keep: timedelta = LOG_RETENTION, day: str | None = None) -> DataFrame:
    """Log rows young enough to keep.

    ``day`` names a date partition column of the log table; whole partitions are
    then skipped without being read.
    """
    kept = logs.where(F.col("ts") >= ago(now, keep))
    return kept.where(F.col(day) >= ago(now, keep).cast("date")) if day else kept


def due_accounts(
    accounts: DataFrame, now: datetime, every: timedelta = INGEST_EVERY, column: str = "latest_ingestion"
) -> DataFrame:
    """Accounts never ingested, or not within ``every``."""
    return accounts.where(F.col(column).isNull() | (F.col(column) <= ago(now, every)))


def _local_time(day: Column) -> Column:
    return F.concat(day.cast("string"), F.lit(" "), F.col("cron_time").cast("string")).try_cast("timestamp_ntz")


def bad_schedules(users: DataFrame) -> DataFrame:
    """Users whose ``cron_time`` is NULL or no time of day, or whose zone is unknown."""
    unknown = users.join(valid_zones(users.sparkSession), "timezone", "left_anti").select(*users.columns)
    known = users.join(valid_zones(users.sparkSession), "timezone", "left_semi").select(*users.columns)
    return unknown.unionByName(known.where(_local_time(F.lit("2000-01-01")).isNull()))


def due_users(users: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Users whose ``cron_time`` in their ``timezone`` falls in the UTC interval [start, end).

    Adds ``due_at`` in UTC. Zones are up to 14 hours from UTC, so the local dates
    from one day before the start to one day after the end are tried. Users with an
    unknown zone, or without a readable ``cron_time``, are left out; ``bad_schedules``
    lists them.
    """
    known = users.join(valid_zones(users.sparkSession), "timezone", "left_semi")
    first, last = ntz(start).cast("date"), ntz(end).cast("date")
    days = F.sequence(F.date_sub(first, 1), F.date_add(last, 1))
    local = _local_time(F.col("_day"))
    tried = known.select(*users.columns, F.explode(days).alias("_day"))
    due = tried.withColumn("due_at", zoned_to_utc(local, F.col("timezone"))).drop("_day")
    return due.where((F.col("due_at") >= ntz(start)) & (F.col("due_at") < ntz(end)))
