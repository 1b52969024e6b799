"""Per-partition profiles that merge: a re-check of a growing table reads its new partitions only.

A profile has one row per partition and column of the contract: rows, NULLs, values that the declared type cannot
hold, smallest and largest value as text in the declared type's order, and an HLL sketch of the distinct values.
Everything in it merges, so the profile of a table is the merge of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.contract import TableContract
from tablesync.errors import ContractError
from tablesync.operators.guards import converted, lossy

PROFILE = "`partition` string, `column` string, n_rows long, n_null long, n_bad long, low string, high string, sketch binary"
_SKETCH_BITS = 12


def _text(value: Column, want: T.DataType) -> Column:
    return F.hex(value) if isinstance(want, T.BinaryType) else value.cast("string")


def profile_partitions(df: DataFrame, contract: TableContract, partition_by: str) -> DataFrame:
    """The profile of ``df``. One aggregation by partition, combined before it moves: however large a partition
    is, a task sends one row for it."""
    contract.check_known([partition_by], "partition column")
    columns = [c for c in contract.columns if c.name in df.columns and c.name != partition_by]
    found = []
    for c in columns:
        have, given = df.schema[c.name].dataType, F.col(c.name)
        value = converted(given, have, c.type)
        low, high = F.min(value), F.max(value)
        found.append(
            F.struct(
                F.lit(c.name).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(given.isNull()).alias("n_null"),
                F.count_if(lossy(given, have, c.type)).alias("n_bad") if have != c.type else F.lit(0).cast("long").alias("n_bad"),
                _text(low, c.type).alias("low"),
                _text(high, c.type).alias("high"),
                F.hll_sketch_agg(F.xxhash64(value.cast("string")) if not isinstance(c.type, T.BinaryType) else value, _SKETCH_BITS).alias("sketch"),
            )
        )
    per_part = df.groupBy(F.col(partition_by).cast("string").alias("partition")).agg(F.array(*found).alias("_columns"))
    return per_part.select("partition", F.explode("_columns").alias("_c")).select("partition", "_c.*")


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """Parts side by side; a partition that occurs in several takes the last, as one that was read anew."""
    if not profiles:
        raise ContractError("nothing to merge")
    both = profiles[0].withColumn("_n", F.lit(0))
    for n, more in enumerate(profiles[1:], 1):
        both = both.unionByName(more.withColumn("_n", F.lit(n)))
    last = both.groupBy("partition", "column").agg(F.max_by(F.struct(*profiles[0].columns), "_n").alias("_row"))
    return last.select("_row.*")


def profile_summary(profile: DataFrame, contract: TableContract) -> DataFrame:
    """One row per column over all partitions: counts summed, extremes and sketches merged, and
    ``n_distinct``, the sketch's estimate (within about 2 %)."""
    kinds = {c.name: c.type for c in contract.columns}
    parts = []
    for name, kind in kinds.items():
        rows = profile.where(F.col("column") == name)
        typed = (lambda c, k=kind: F.col(c)) if isinstance(kind, T.BinaryType) else (lambda c, k=kind: F.col(c).cast(k))
        parts.append(
            rows.groupBy("column").agg(
                F.sum("n_rows").alias("n_rows"),
                F.sum("n_null").alias("n_null"),
                F.sum("n_bad").alias("n_bad"),
                F.min(typed("low")).cast("string").alias("low"),
                F.max(typed("high")).cast("string").alias("high"),
                F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"),
            )
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def profile_update(
    spark: SparkSession, path: str, profile: DataFrame | None, contract: TableContract, partition_by: str, schema: T.StructType | None = None
) -> DataFrame:
    """``profile`` extended by the partitions of the table at ``path`` that it lacks.

    The partitions are told by their folders' names, which prune the scan; as many of them are listed as there
    are folders. Without a profile the whole table is read.
    """
    table = spark.read.schema(schema or contract.struct()).parquet(path)
    if profile is None:
        return profile_partitions(table, contract, partition_by)
    part = F.col(partition_by).cast("string")
    seen = [r[0] for r in profile.select("partition").distinct().collect()]
    known = F.coalesce(part.isin([v for v in seen if v is not None]), F.lit(None in seen))
    return merge_profiles(profile, profile_partitions(table.where(~known), contract, partition_by))
