"""Compare registered queries with their SQL twins: ``python -m catalog.compare SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from catalog.oracle import ORACLE
from catalog.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


# Spark type -> DuckDB type; anything else must have the same name.
TYPES = {"string": "varchar", "int": "integer", "timestamp_ntz": "timestamp"}


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when rows and columns agree, else what differs."""
    columns = sorted(df.columns)
    expected = con.sql(sql)
    if columns != sorted(expected.columns):
        return f"columns {columns} against {sorted(expected.columns)}"
    theirs_by_name = dict(zip(expected.columns, map(str, expected.types), strict=True))
    for name, dtype in df.dtypes:
        if TYPES.get(dtype, dtype) != theirs_by_name[name].lower():
            return f"type of {name}: {dtype} against {theirs_by_name[name]}"
    ours = Counter(tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = Counter(con.sql(f"SELECT {quoted} FROM ({sql}) AS q").fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {only_ours}; only SQL {only_theirs}"


def main(sf_dir: str, names: list[str]) -> int:
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", "8"
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = differences(QUERIES[name](spark, sf_dir), con, ORACLE[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{time.time() - start:6.2f}s {name}: {problem or 'equal'}", flush=True)
    print(f"{failed} of {len(names or QUERIES)} differ; not in SQL: {sorted(set(QUERIES) - set(ORACLE))}")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
