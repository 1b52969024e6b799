"""Headline queries on one machine; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the best time
counts. Results go to a sink that takes every row and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES  # noqa: E402
from tablesync import build_session  # noqa: E402

HEADLINE = [
    "merge_upsert",
    "merge_upsert_in_place",
    "merge_full_sync",
    "merge_metrics",
    "insert_ignore",
    "append_strict",
    "dedupe_by_key",
    "run_outcome",
    "step_order",
    "month_plan",
    "incremental_since",
    "surrogate_key",
    "accounts_for_user",
    "log_tail",
    "pk_integrity",
    "ingest_batch_games",
    "sync_partitions",
    "landing_load",
    "ingest_stream",
    "sync_partitions_full",
    "merge_bucketed",
    "lock_conflicts",
    "cascade_delete",
    "table_profile",
    "ragged_records",
    "stream_dedupe_rejects",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = float("inf")
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - start
            best = min(best, elapsed)
        seconds[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_best_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
