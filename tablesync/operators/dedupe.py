"""Making a batch unique per key, and numbering rows inside a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.operators.guards import any_null, required
from tablesync.operators.running import number_rows


# Above this Spark no longer limits groups before a shuffle by itself.
GROUP_LIMIT = 1000
PARTS = 64


def top_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key.

    The rank limit is applied before rows of a key meet as well as after, so a key that
    holds most of the rows brings at most ``n`` of them per task, or per part, together.
    """
    if n > GROUP_LIMIT:
        # Spark limits groups ahead of the shuffle only for small n; here a key is first cut
        # to n rows in each of several parts.
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        return _first(_first(df.withColumn("_part", part), [*keys, "_part"], order_by, n).drop("_part"), keys, order_by, n)
    return _first(df, keys, order_by, n)


def _first(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def dedupe_by_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], *, null_keys: bool = True
) -> DataFrame:
    """One row per key: the first in ``order_by``, which should be a total order.

    Pass descending columns for "latest wins". A key with a NULL part equals no
    other key, so those rows all stay; ``null_keys=False`` says there are none.
    """
    if not null_keys:
        return top_per_key(df, keys, order_by)
    # A row with a NULL in its key gets a number of its own, so it competes with no other.
    alone = F.when(any_null(keys), F.monotonically_increasing_id())
    return top_per_key(df.withColumn("_alone", alone), [*keys, "_alone"], order_by).drop("_alone")


def number_in_group(
    df: DataFrame,
    group: str,
    time: str,
    tie: Sequence[str],
    *,
    alias: str,
    parts: int | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, ordered by ``time`` and ``tie``.

    A distributed prefix sum (``number_rows``): a group is cut by time and tie into ranges of
    even size, so neither a long group nor one whose rows share an instant is ranked by one
    task. ``parts`` sets the number of ranges. A row without group or time has no position
    and fails the job, which runs when this is called.
    """
    needed = {c: required(F.col(c), f"{c} is NULL, so {alias} is not defined") for c in (group, time)}
    return number_rows(df.withColumns(needed), [group], [time, *tie], alias, parts)
