"""Key predicates, surrogate keys and value domains."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.errors import ContractError, PredicateError
from tablesync.functions.times import python_text

_LITERAL = re.compile(r"('(?:[^']|'')*')")
_QUOTED_NAME = re.compile(r'"([A-Za-z_][A-Za-z0-9_]*)"')


def as_predicate(condition: Column | str | None, operation: str) -> Column:
    """A mandatory predicate as a Column; blank text or None is refused.

    In text, names in double quotes become names in backticks: Spark would read
    ``"a" = 'b'`` as two string literals and match nothing.
    """
    if condition is None or (isinstance(condition, str) and not condition.strip()):
        raise PredicateError(f"{operation} needs a predicate")
    if isinstance(condition, Column):
        return condition
    pieces = _LITERAL.split(condition)
    pieces[::2] = [_QUOTED_NAME.sub(r"`\1`", piece) for piece in pieces[::2]]
    return F.expr("".join(pieces))


def null_safe_equal(column: str, value: Any) -> Column:
    """``column = value``, or ``column IS NULL`` when the value is None."""
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def key_predicate(columns: Iterable[str], values: Iterable[Any]) -> Column:
    """AND of null-safe comparisons over a composite key."""
    pairs = list(zip(list(columns), list(values), strict=True))
    if not pairs:
        raise PredicateError("a key predicate needs at least one column")
    return reduce(and_, (null_safe_equal(c, v) for c, v in pairs))


def surrogate_key(df: DataFrame, columns: Iterable[str]) -> Column:
    """Hex SHA-256 of the comma-joined text of ``columns``, in order.

    NULL hashes as ``None`` and booleans as ``True``/``False``. The separator is
    not escaped, so ("a,b", "c") and ("a", "b,c") share a key.
    """
    columns = list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing or not columns:
        raise ContractError(f"surrogate key columns are missing: {missing or 'none given'}")
    texts = [F.coalesce(_hash_text(F.col(c), df.schema[c].dataType), F.lit("None")) for c in columns]
    return F.sha2(F.concat_ws(",", *texts), 256)


def _hash_text(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(dtype, T.TimestampNTZType):
        return python_text(column)
    if isinstance(dtype, T.StringType | T.IntegralType | T.DateType):
        return column.cast("string")
    raise ContractError(f"cannot hash a column of type {dtype.simpleString()}")


def enum_valid(column: Column | str, domain: Iterable[str]) -> Column:
    """True when the value is in the domain. NULL is never in a domain."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.isin(list(domain)), F.lit(False))
