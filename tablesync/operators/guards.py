"""Strict checks that live inside the plan.

A guard is a one-value subquery counting violations. The rows it protects pass
through a filter that fails the job when the count is not zero, so a result can
never be read past a violation and building the plan runs nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.times import try_text_to_utc

def any_null(columns: Iterable[str]) -> Column:
    return reduce(or_, (F.col(c).isNull() for c in columns))


def fail_when(condition: Column, message: Column | str) -> Column:
    """A filter condition that keeps every row, or fails the job."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.raise_error(message)).otherwise(F.lit(True))


def key_set(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys. Map-side aggregation dissolves a key that many rows share,
    and a following join on the same keys reuses the exchange."""
    return df.select(*keys).distinct()


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count. A key with a NULL part
    equals no other key, so it is never a duplicate."""
    counted = df.where(~any_null(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") > 1)


def guard_empty(df: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``df`` unchanged, failing at run time if ``violations`` has any row."""
    found = violations.agg(F.count(F.lit(1)).alias("n")).scalar()
    text = F.concat(F.lit(f"{message}: "), found.cast("string"))
    return df.where(fail_when(found > 0, text))


def converted(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """The value in another type, NULL where it does not cast. Zone-less timestamps hold UTC, so the
    zone of a text is applied, not cut off."""
    if isinstance(have, T.StringType) and isinstance(want, T.TimestampNTZType):
        return try_text_to_utc(column)
    return column.try_cast(want)


def lossy(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """True for a value that another type cannot hold: it does not cast, or does not come back.

    Text may spell a value in many ways, so it is compared in the widest type of its
    kind. Between floating-point types rounding is expected.
    """
    cast = converted(column, have, want)
    lost = column.isNotNull() & cast.isNull()
    floats = (T.FloatType, T.DoubleType)
    if isinstance(want, T.StringType) or (isinstance(have, floats) and isinstance(want, floats)):
        return lost
    if isinstance(have, T.StringType):
        wide = {T.DateType: T.TimestampNTZType(), T.DecimalType: T.DecimalType(38, 18)}.get(type(want))
        if wide is None:
            return lost
        return lost | ~F.coalesce(column.try_cast(wide) == cast.cast(wide), cast.isNull())
    return lost | ~F.coalesce(cast.try_cast(have) == column, cast.isNull())


def exact_cast(df: DataFrame, name: str, want: T.DataType) -> Column:
    """The column in another type; a value that does not survive fails the job in any
    session, with ANSI mode on or off."""
    column = F.col(name)
    if df.schema[name].dataType == want:
        return column
    cast = converted(column, df.schema[name].dataType, want)
    lost = lossy(column, df.schema[name].dataType, want)
    message = F.concat(F.lit(f"{name} does not cast to {want.simpleString()}: "), column.cast("string"))
    return F.when(lost, F.raise_error(message)).otherwise(cast)


def required(column: Column, message: Column | str) -> Column:
    """The column's value, failing on NULL. Unlike a filter this also holds below an
    inner join, where the optimizer would drop NULL keys before a filter sees them."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(column.isNull(), F.raise_error(message)).otherwise(column)


def guard_not_null(df: DataFrame, columns: Iterable[str], table: str, rows: Column | None = None) -> DataFrame:
    """Fail on a NULL in ``columns``, looking only at ``rows`` when given."""
    for column in columns:
        broken = F.col(column).isNull()
        df = df.where(
            fail_when(broken if rows is None else rows & broken, f"NULL in {table}.{column}, declared NOT NULL")
        )
    return df
