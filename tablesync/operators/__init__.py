"""Operators: each takes DataFrames and gives DataFrames."""

from tablesync.operators.cascade import cascade_delete, reference_check
from tablesync.operators.dedupe import dedupe_by_key, number_in_group, top_per_key
from tablesync.operators.guards import duplicate_keys, guard_empty, guard_not_null, key_set
from tablesync.operators.ingest import (
    ENVELOPE,
    GAME,
    advanced_accounts,
    game_flatten,
    game_rejects,
    games_explode,
    incremental_since,
    month_plan,
    range_plan,
)
from tablesync.operators.ledger import (
    active_locks,
    due_accounts,
    bad_schedules,
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
from tablesync.operators.links import (
    account_list,
    accounts_for_user,
    link_add,
    link_remove,
    live_links,
    orphan_accounts,
    stale_links,
    unlink_cascade,
)
from tablesync.operators.merge import absent_from, merge, watermark_advance
from tablesync.operators.outcome import WriteOutcome
from tablesync.operators.profile import merge_profiles, profile_partitions, profile_summary, profile_update
from tablesync.operators.quality import (
    contract_check,
    default_fill,
    diff_verdict,
    enum_check,
    pk_integrity,
    schema_diff,
    schema_reconcile,
    timezone_check,
    valid_zones,
)
from tablesync.operators.ragged import found_fields, ragged_records, ragged_schema
from tablesync.operators.reads import (
    concat_batches,
    keyed_lookup,
    keys_exist,
    row_count,
    row_exists,
    table_read,
)
from tablesync.operators.running import highest_before, number_rows, running_totals
from tablesync.operators.writes import append_strict, delete_where, insert_ignore, overwrite, update_where

__all__ = [name for name in dir() if not name.startswith("_")]
