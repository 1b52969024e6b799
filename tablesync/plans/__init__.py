"""Jobs composed of operators."""

from tablesync.plans.buckets import bucket_count, bucketed_outcome, merge_bucketed, write_bucketed
from tablesync.plans.jobs import ingest_batch, nightly_maintenance, sync_partitions, table_transform

__all__ = [
    "bucket_count",
    "bucketed_outcome",
    "ingest_batch",
    "merge_bucketed",
    "nightly_maintenance",
    "sync_partitions",
    "table_transform",
    "write_bucketed",
]
