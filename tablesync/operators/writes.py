"""Append, insert-ignore, overwrite, and predicate update and delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.contract import TableContract, exact_literal
from tablesync.errors import ContractError
from tablesync.functions.keys import as_predicate
from tablesync.operators.dedupe import dedupe_by_key
from tablesync.operators.guards import duplicate_keys, guard_empty, guard_not_null
from tablesync.operators.merge import absent_from, supplied_columns, typed, with_defaults
from tablesync.operators.outcome import ACTION, DELETE, INSERT, KEEP, UPDATE, WriteOutcome, tag


def _incoming(source: DataFrame, contract: TableContract) -> DataFrame:
    names = supplied_columns(source, contract)
    full = with_defaults(typed(source, contract, names), contract)
    return guard_not_null(full, contract.required, contract.name)


def append_strict(target: DataFrame, source: DataFrame, contract: TableContract) -> WriteOutcome:
    """Add all rows; a key clash inside the batch or with the target fails all of it."""
    batch = _incoming(source, contract)
    key = list(contract.primary_key)
    if key:
        clashes = batch.select(*key).unionByName(target.join(batch.select(*key), key, "left_semi").select(*key))
        batch = guard_empty(batch, duplicate_keys(clashes, key), f"primary key clash in {contract.name}")
    tagged = tag(target.select(*contract.column_names), KEEP).unionByName(tag(batch, INSERT))
    return WriteOutcome("append", tagged, tuple(contract.column_names))


def insert_ignore(
    target: DataFrame,
    source: DataFrame,
    contract: TableContract,
    order_by: Sequence[Column | str] = (),
) -> WriteOutcome:
    """Add rows whose key is new. Within the batch the first in ``order_by`` wins.

    Without ``order_by`` the batch must hold each key once.
    """
    key = list(contract.primary_key)
    if not key:
        raise ContractError(f"{contract.name} has no primary key")
    batch = _incoming(source, contract)
    if order_by:
        batch = dedupe_by_key(batch, key, order_by, null_keys=False)
    else:
        batch = guard_empty(batch, duplicate_keys(batch, key), f"duplicate source keys for {contract.name}")
    fresh = absent_from(batch, target, key, unique_target=False)
    tagged = tag(target.select(*contract.column_names), KEEP).unionByName(tag(fresh, INSERT))
    return WriteOutcome("insert_ignore", tagged, tuple(contract.column_names))


def overwrite(source: DataFrame, contract: TableContract) -> WriteOutcome:
    """Replace the table. The batch is checked in the plan that writes it, so a bad
    batch fails before anything is published; an empty one leaves an empty table."""
    batch = _incoming(source, contract)
    key = list(contract.primary_key)
    if key:
        batch = guard_empty(batch, duplicate_keys(batch, key), f"primary key clash in {contract.name}")
    return WriteOutcome("overwrite", tag(batch, INSERT), tuple(contract.column_names))


def update_where(
    target: DataFrame,
    values: Mapping[str, Any],
    where: Column | str,
    contract: TableContract,
) -> WriteOutcome:
    """Set constants on the rows matching a mandatory predicate.

    A predicate that is NULL for a row leaves it alone.
    """
    condition = as_predicate(where, "update_where")
    if not values:
        raise ContractError("update_where needs at least one column")
    contract.check_known(values, "updated columns")
    hit = F.coalesce(condition, F.lit(False))
    # The predicate sees the row as it was, whichever columns are set.
    marked = target.select(*contract.column_names, hit.alias("_hit"))
    tagged = marked.select(
        *(
            F.when(F.col("_hit"), exact_literal(values[c.name], c.type)).otherwise(F.col(c.name)).alias(c.name)
            if c.name in values
            else F.col(c.name)
            for c in contract.columns
        ),
        F.when(F.col("_hit"), F.lit(UPDATE)).otherwise(F.lit(KEEP)).alias(ACTION),
    )
    if any(values[c] is None for c in values if c in contract.required):
        tagged = guard_not_null(tagged, [c for c in values if c in contract.required], contract.name)
    return WriteOutcome("update_where", tagged, tuple(contract.column_names))


def delete_where(target: DataFrame, where: Column | str, columns: Sequence[str] | None = None) -> WriteOutcome:
    """Remove the rows matching a mandatory predicate; a NULL predicate keeps the row."""
    hit = F.coalesce(as_predicate(where, "delete_where"), F.lit(False))
    tagged = target.withColumn(ACTION, F.when(hit, F.lit(DELETE)).otherwise(F.lit(KEEP)))
    return WriteOutcome("delete_where", tagged, tuple(columns or target.columns))
