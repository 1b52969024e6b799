"""Merges into very large tables that are laid out by their key.

A table bucketed and sorted by its primary key is joined where it lies: a merge shuffles the source alone, into as
many parts as the table has buckets. The next state leaves the join by bucket again and is written as the next
table of the same layout, one file per bucket, without a shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesync.contract import TableContract
from tablesync.errors import ContractError
from tablesync.operators.merge import merge
from tablesync.operators.outcome import ACTION, DELETE, INSERT, UPDATE, WriteOutcome


def write_bucketed(df: DataFrame, name: str, contract: TableContract, buckets: int, path: str | None = None) -> None:
    """``df`` as table ``name`` in the catalog, bucketed and sorted by the contract's primary key; its files
    under ``path`` if given. One file per bucket."""
    if not contract.primary_key:
        raise ContractError(f"{contract.name} has no primary key to lay out by")
    _save(df.select(*contract.column_names).repartition(buckets, *contract.primary_key), name, contract, buckets, path)


def _save(df: DataFrame, name: str, contract: TableContract, buckets: int, path: str | None) -> None:
    first, *rest = contract.primary_key
    writer = df.write.format("parquet").bucketBy(buckets, first, *rest).sortBy(first, *rest)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def bucket_count(spark: SparkSession, name: str, contract: TableContract) -> int:
    """Buckets of a table that is laid out by the contract's primary key."""
    notes = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    columns = notes.get("Bucket Columns", "").strip("[]").replace("`", "").replace(" ", "")
    if columns != ",".join(contract.primary_key):
        raise ContractError(f"{name} is not bucketed by {list(contract.primary_key)}")
    return int(notes["Num Buckets"])


def bucketed_outcome(spark: SparkSession, name: str, source: DataFrame, contract: TableContract, **merge_options) -> WriteOutcome:
    """``merge`` into a bucketed table on its primary key. The target has no exchange in the plan."""
    if merge_options.get("keys") not in (None, list(contract.primary_key), contract.primary_key):
        raise ContractError("a bucketed table is merged on its primary key")
    buckets = bucket_count(spark, name, contract)
    laid = source.repartition(buckets, *contract.primary_key)
    return merge(spark.table(name), laid, contract, **{"shape": "full_outer", **merge_options})


def merge_bucketed(
    spark: SparkSession, name: str, source: DataFrame, contract: TableContract, next_name: str, path: str | None = None, **merge_options
) -> dict:
    """Merge ``source`` into the bucketed table ``name`` and write the next state as ``next_name``, laid out alike.

    Gives the counts, observed in the stage that writes. Renaming or dropping tables is the caller's.
    """
    done = bucketed_outcome(spark, name, source, contract, **merge_options)
    seen = Observation()
    observed = done.tagged.observe(
        seen,
        F.count_if(F.col(ACTION) == INSERT).alias("rows_inserted"),
        F.count_if(F.col(ACTION) == UPDATE).alias("rows_updated"),
        F.count_if(F.col(ACTION) == DELETE).alias("rows_deleted"),
    )
    state = observed.where(F.col(ACTION) != DELETE).select(*done.columns)
    _save(state, next_name, contract, bucket_count(spark, name, contract), path)
    return {"strategy": done.strategy, **seen.get}
