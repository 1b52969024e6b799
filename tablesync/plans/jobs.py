"""Whole jobs: ingest a batch, transform a table, clean up, merge into partitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.contract import TableContract
from tablesync.errors import ContractError
from tablesync.operators.guards import guard_empty
from tablesync.operators.ingest import advanced_accounts, game_flatten, game_rejects, incremental_since
from tablesync.operators.ledger import log_retention, purge_runs
from tablesync.operators.links import live_links, orphan_accounts
from tablesync.operators.merge import merge, watermark_advance
from tablesync.operators.outcome import WriteOutcome
from tablesync.operators.reads import table_read
from tablesync.operators.writes import insert_ignore, overwrite
from tablesync.session import discard, scratch_dir, stored
from tablesync.swaps import Folder, aside, mend, publish


@dataclass(frozen=True)
class IngestBatch:
    """Next state of the games table and of the accounts' watermarks, and the recent
    records too incomplete to become games."""

    games: WriteOutcome
    accounts: WriteOutcome
    rejects: DataFrame


def ingest_batch(
    records: DataFrame,
    accounts: DataFrame,
    games: DataFrame,
    games_contract: TableContract,
    accounts_contract: TableContract,
    run_started_at: datetime,
    *,
    source_file: str | None = None,
) -> IngestBatch:
    """Landed records to table rows: since-filter, flatten, insert-ignore, watermark.

    Publish ``games`` before ``accounts``: a crash in between repeats records, which
    insert-ignore drops, and never loses any.
    """
    recent = incremental_since(records, accounts)
    flat = game_flatten(recent, source_file=source_file, strict=False)
    order = [F.col("played_at").asc_nulls_last(), *(c for c in flat.columns if c != "played_at")]
    return IngestBatch(
        games=insert_ignore(games, flat, games_contract, order_by=order),
        accounts=watermark_advance(
            accounts, advanced_accounts(recent, run_started_at), accounts_contract, "latest_ingestion"
        ),
        rejects=game_rejects(recent),
    )


def table_transform(
    table: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    contract: TableContract,
    *,
    columns: Sequence[str] | None = None,
    where: Column | str | None = None,
) -> WriteOutcome:
    """Read a table, transform it, and replace another table with the result."""
    return overwrite(table_read(table, columns, where).transform(transform), contract)


@dataclass(frozen=True)
class Maintenance:
    runs: WriteOutcome
    links: DataFrame
    orphans: DataFrame
    logs: DataFrame


def nightly_maintenance(
    runs: DataFrame, bridge: DataFrame, accounts: DataFrame, logs: DataFrame, now: datetime
) -> Maintenance:
    """Purge abandoned runs, drop stale links, report orphan accounts, expire logs."""
    links = live_links(bridge, accounts)
    return Maintenance(purge_runs(runs, now), links, orphan_accounts(accounts, links), log_retention(logs, now))


def _folder_of(spark: SparkSession, column: str, value: str | None) -> str:
    """Spark's own folder name of a partition value, escapes included."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return names.getPartitionPathString(column, value)


def sync_partitions(
    path: str, source: DataFrame, contract: TableContract, partition_by: str, *, delete_within: str = "table", **merge_options
) -> dict:
    """Merge into a partitioned Parquet table, rewriting only the partitions the source touches.

    Partitions that lose all their rows vanish. ``when_not_matched_by_source="delete"`` makes it a full sync: of the
    whole table, so that partitions without a source row are dropped unread, or with ``delete_within="touched"``
    of the partitions the source has rows for. An empty source changes nothing.

    The source is run once and kept in scratch. Its distinct partition values, as many as it touches folders,
    prune the table's folders by name, so two days of a year read two days. The merged partitions are written once,
    beside the table, and swapped in by a list of moves: after a crash between any two steps, calling again mends the
    table first (``tablesync.swaps``). A key's partition value must not change: a source key held by a partition
    that the source does not touch fails the job; of those partitions the keys alone are read for that.
    """
    if delete_within not in ("table", "touched"):
        raise ContractError(f"delete_within must be 'table' or 'touched', not {delete_within!r}")
    contract.check_known([partition_by], "partition column")
    if partition_by not in source.columns:
        raise ContractError(f"source lacks the partition column {partition_by!r}")
    spark = source.sparkSession
    folder = Folder(spark, path)
    mend(folder)
    kept, staging = scratch_dir(spark, "sync-source"), aside()
    try:
        source = stored(source, kept)
        part = F.col(partition_by)
        values = [r[0] for r in source.select(part.cast(contract.column(partition_by).type)).distinct().collect()]
        if not values:
            return {"strategy": "merge", "rows_inserted": 0, "rows_updated": 0, "rows_deleted": 0}
        touched = part.isin([v for v in values if v is not None])
        touched = F.coalesce(touched, F.lit(None in values))
        table = spark.read.schema(contract.struct()).parquet(path)
        keys = list(merge_options.get("keys") or contract.primary_key)
        rest = table.where(~touched)
        moved = rest.select(*keys).join(source.select(*keys), keys, "left_semi")
        checked = guard_empty(source, moved, f"source keys of {contract.name} held by another partition")
        target = table.where(touched).select(*contract.column_names)
        done = merge(target, checked, contract, **merge_options)
        counts = done.write(f"{folder.root}/{staging}", partition_by=[partition_by])
        prefix = f"{partition_by}="
        put = [n for n in folder.names(staging) if n.startswith(prefix)]
        there = [n for n in folder.names() if n.startswith(prefix)]
        texts = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", contract.column(partition_by).type)]))
        ours = {_folder_of(spark, partition_by, r[0]) for r in texts.select(F.col("v").cast("string")).collect()}
        gone = [n for n in there if n in ours]
        if merge_options.get("when_not_matched_by_source") == "delete" and delete_within == "table":
            counts["rows_deleted"] += rest.count()
            gone = there
        publish(folder, staging, put, sorted(set(gone) - set(put)))
        return counts
    finally:
        discard(spark, kept)
