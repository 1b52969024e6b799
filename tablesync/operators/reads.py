"""Table reads, counts, existence and keyed look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.keys import as_predicate
from tablesync.operators.guards import fail_when, key_set
from tablesync.session import fits_broadcast


def table_read(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    where: Column | str | None = None,
    order_by: Sequence[Column | str] | Column | str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Filter, sort, limit, project. The filter and sort see every column.

    Plain names in ``order_by`` sort ascending with NULLs last. A limit of 0 is a limit.
    """
    if where is not None and not (isinstance(where, str) and not where):
        df = df.where(as_predicate(where, "table_read"))
    if order_by is not None:
        items = [order_by] if isinstance(order_by, Column | str) else list(order_by)
        df = df.orderBy(*(F.col(i).asc_nulls_last() if isinstance(i, str) else i for i in items))
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def row_count(df: DataFrame, where: Column | str | None = None) -> DataFrame:
    """One row ``(n_rows)``. A predicate may be left out, but not be blank."""
    if where is not None:
        df = df.where(as_predicate(where, "row_count"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def row_exists(df: DataFrame, where: Column | str) -> DataFrame:
    """One row ``(found)``; each task stops reading at its first match."""
    hit = df.where(as_predicate(where, "row_exists")).select(F.lit(1)).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))


def keys_exist(requested: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existence for a batch of keys: one row per distinct requested key, with ``found``."""
    keys = list(keys)
    held = key_set(target, keys).withColumn("_held", F.lit(True))
    asked = key_set(requested, keys)
    return asked.join(held, keys, "left").select(*keys, F.col("_held").isNotNull().alias("found"))


def keyed_lookup(
    requested: DataFrame,
    target: DataFrame,
    key: str,
    columns: Sequence[str] = (),
    *,
    strict: bool = False,
) -> DataFrame:
    """Fetch exactly one row per distinct requested key.

    Gives the key, ``n_found``, ``status`` (ok, missing, ambiguous) and, when the
    status is ok, the target's ``columns``. ``strict`` fails on any other status.
    Both sides are reduced per key before they meet, so no key can be hot.
    """
    asked = key_set(requested, [key])
    rows = target.select(key, *columns)
    if fits_broadcast(requested):
        rows = rows.join(asked, key, "left_semi")
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.min(c).alias(c) for c in columns))
    joined = asked.join(found, key, "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    status = F.when(n == 1, "ok").when(n == 0, "missing").otherwise("ambiguous")
    if strict:
        message = F.concat(F.lit("no unique row for key "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
        joined = joined.where(fail_when(n != 1, message))
    return joined.select(
        key,
        n.cast("bigint").alias("n_found"),
        status.alias("status"),
        *(F.when(n == 1, F.col(c)).alias(c) for c in columns),
    )


def concat_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Stack batches, keeping duplicates; a column a batch lacks is NULL there."""
    if not batches:
        raise ValueError("concat_batches needs at least one batch")
    first, *rest = batches
    for batch in rest:
        first = first.unionByName(batch, allowMissingColumns=True)
    return first
