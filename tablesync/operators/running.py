"""Prefix sums over ordered groups of any size.

Rows are range-partitioned by group and order, so a group that holds most of the rows, even all at one
instant, is cut into as many parts as its ties allow. Each part is sorted once and written down; what
a part adds is one row per group in it, and only those rows meet per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.session import scratch_dir, stored

_AT, _PART, _GROUP = "_at", "_part", "_group"
# A row's number in its partition is in the low 33 bits of Spark's increasing ids, the partition above.
PART_BIT = 33


def in_ranges(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], parts: int | None = None
) -> DataFrame:
    """``df`` in sorted ranges on shared storage, with ``_at``, which grows along the order, and ``_part``.

    The boundaries come from a sample and would differ in a second run of the same plan, hence the table.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    placed = ranged.sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id())
    return stored(placed.withColumn(_PART, F.shiftright(_AT, PART_BIT)), scratch_dir(df.sparkSession, "ranges"))


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], alias: str, parts: int | None = None
) -> DataFrame:
    """Zero-based position of each row in its group, by ``order``, NULL being a group like any other.

    Runs one job when called: the rows are laid out in ranges. Their number is then their place in the
    range, shifted by the range's own offset for the group; offsets are broadcast where few.
    """
    placed = in_ranges(df, group, order, parts).withColumn(_GROUP, F.struct(*group))
    starts = placed.groupBy(_GROUP, _PART).agg(F.min(_AT).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(_GROUP).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    offsets = starts.select(_GROUP, _PART, (before - F.col("_first")).alias("_shift"))
    numbered = placed.join(offsets, [_GROUP, _PART])
    return numbered.select(*df.columns, (F.col(_AT) + F.col("_shift")).cast("bigint").alias(alias))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    totals: Mapping[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """``df`` with the sum of each value of ``totals`` over the rows of its group up to and with this one.

    A NULL adds nothing; a total of NULLs alone is 0.
    """
    values = {a: F.coalesce(v, F.lit(0)) for a, v in totals.items()}
    return _running(df, group, order, values, F.sum, lambda before, inside: F.coalesce(before, F.lit(0)) + inside, 0, parts)


def highest_before(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    values: Mapping[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """``df`` with the largest of each value over the rows of its group before this one, NULL where there is none."""
    return _running(df, group, order, values, F.max, F.greatest, -1, parts)


def _running(df, group, order, values, total, joined_to, end, parts) -> DataFrame:
    """Running aggregates over ranges: each range's own for a group, continued by those of the ranges before."""
    named = {f"_v{i}": v for i, v in enumerate(values.values())}
    placed = in_ranges(df.withColumns(named), group, order, parts).withColumn(_GROUP, F.struct(*group))
    sums = placed.groupBy(_GROUP, _PART).agg(*(total(v).alias(f"_all{v}") for v in named))
    earlier = Window.partitionBy(_GROUP).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(_GROUP, _PART, *(total(f"_all{v}").over(earlier).alias(f"_before{v}") for v in named))
    inside = Window.partitionBy(_GROUP, _PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, end)
    # The windows lay the rows out by the join keys; only the offsets move.
    summed = placed.withColumns({f"_in{v}": total(v).over(inside) for v in named})
    joined = summed.join(offsets, [_GROUP, _PART])
    both = {v: joined_to(F.col(f"_before{v}"), F.col(f"_in{v}")) for v in named}
    return joined.select(*df.columns, *(both[v].alias(a) for v, a in zip(named, values, strict=True)))
