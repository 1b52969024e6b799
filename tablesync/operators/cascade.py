"""Declared references: rows whose parent is missing, and deletes that follow them.

Tables are given by the table name of their contract. Deletions are sets of primary keys. Tables that do not
refer to each other in a ring are visited once, parents first, in one plan; a ring, or a table that refers to
itself, is followed round by round until no new key is found, each round a table on shared storage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.contract import Reference, TableContract
from tablesync.errors import ContractError
from tablesync.operators.guards import any_null, guard_empty
from tablesync.session import scratch_dir, stored


def _by_name(contracts: Sequence[TableContract]) -> dict[str, TableContract]:
    named = {c.table_name: c for c in contracts}
    for c in contracts:
        for r in c.references:
            if r.table not in named:
                raise ContractError(f"{c.name} refers to {r.table}, which has no contract here")
            named[r.table].check_known(r.parent_columns, f"columns referred to by {c.name}")
    return named


def reference_check(tables: Mapping[str, DataFrame], contracts: Sequence[TableContract]) -> DataFrame:
    """One row per declared reference ``(table, columns, parent, n_bad)``: rows that name no row of the parent."""
    rows = []
    for name, contract in _by_name(contracts).items():
        for r in contract.references:
            child = tables[name].where(~any_null(r.columns)).select(*r.columns)
            parent = tables[r.table].select(*(F.col(p).alias(c) for p, c in zip(r.parent_columns, r.columns, strict=True)))
            bad = child.join(parent, list(r.columns), "left_anti").agg(F.count(F.lit(1)).alias("n_bad"))
            labels = {"table": name, "columns": ",".join(r.columns), "parent": r.table}
            rows.append(bad.select(*(F.lit(v).alias(k) for k, v in labels.items()), "n_bad"))
    if not rows:
        raise ContractError("no contract declares a reference")
    return reduce(DataFrame.unionByName, rows)


def _rings(contracts: Mapping[str, TableContract]) -> list[list[str]]:
    """Tables in groups, parents before children; tables of one group reach each other."""
    below: dict[str, set[str]] = {n: set() for n in contracts}
    for name, contract in contracts.items():
        for r in contract.references:
            if r.on_delete == "cascade":
                below[r.table].add(name)
    reach = {n: _closure(n, below) for n in contracts}
    groups: list[list[str]] = []
    for name in contracts:
        ring = sorted(m for m in contracts if m == name or (m in reach[name] and name in reach[m]))
        if ring not in groups:
            groups.append(ring)
    # A group goes after all that reach it: those are reached by fewer.
    return sorted(groups, key=lambda g: (sum(g[0] in reach[n] for n in contracts if n not in g), g))


def _closure(start: str, below: Mapping[str, set[str]]) -> set[str]:
    seen: set[str] = set()
    todo = [start]
    while todo:
        for child in below[todo.pop()] - seen:
            seen.add(child)
            todo.append(child)
    return seen


def _named_by(tables, contracts, parent: str, r: Reference, keys: DataFrame) -> DataFrame:
    """The values by which children name the parent rows with these primary keys, as the children's columns."""
    own = list(contracts[parent].primary_key)
    rows = keys
    if not set(r.parent_columns) <= set(own):
        rows = tables[parent].join(keys, own, "left_semi")
    return rows.select(*(F.col(p).alias(c) for p, c in zip(r.parent_columns, r.columns, strict=True)))


def _children(tables, contracts, name: str, r: Reference, parents: DataFrame) -> DataFrame:
    """Primary keys of the rows of ``name`` that refer to ``parents`` (primary keys) by ``r``."""
    named = _named_by(tables, contracts, r.table, r, parents)
    return tables[name].join(named, list(r.columns), "left_semi").select(*contracts[name].primary_key)


def cascade_delete(
    tables: Mapping[str, DataFrame], contracts: Sequence[TableContract], table: str, removed: DataFrame
) -> dict[str, DataFrame]:
    """The next state of every table once the rows of ``table`` with the keys in ``removed`` are gone.

    Rows that refer to a deleted row go too (``cascade``), lose their reference (``set_null``), or
    fail the job (``restrict``, unless they are deleted themselves).
    """
    named = _by_name(contracts)
    for contract in contracts:
        if not contract.primary_key:
            raise ContractError(f"{contract.name} needs a primary key to be cascaded through")
    start = removed.select(*named[table].primary_key).distinct()
    gone: dict[str, DataFrame] = {table: start}
    for ring in _rings(named):
        found = {n: [gone[n]] if n in gone else [] for n in ring}
        for name in ring:
            for r in named[name].references:
                if r.on_delete == "cascade" and r.table not in ring and r.table in gone:
                    found[name].append(_children(tables, named, name, r, gone[r.table]))
        sets = {n: reduce(DataFrame.unionByName, parts).distinct() for n, parts in found.items() if parts}
        inner = [(n, r) for n in ring for r in named[n].references if r.on_delete == "cascade" and r.table in ring]
        gone.update(_fixed_point(tables, named, inner, sets) if inner and sets else sets)
    return {name: _left(tables, named, name, gone) for name in named}


def _fixed_point(tables, named, links: list[tuple[str, Reference]], sets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``sets`` and all that they reach by ``links``. Only keys new in a round are followed in the next."""
    spark = next(iter(sets.values())).sparkSession
    keep = lambda df, name: stored(df, scratch_dir(spark, f"cascade-{name}"))
    rounds = {n: [keep(s, n)] for n, s in sets.items()}
    fresh = {n: r[0] for n, r in rounds.items()}
    while fresh:
        hits: dict[str, list[DataFrame]] = {}
        for name, r in links:
            if r.table in fresh:
                hits.setdefault(name, []).append(_children(tables, named, name, r, fresh[r.table]))
        fresh = {}
        for name, parts in hits.items():
            new = reduce(DataFrame.unionByName, parts).distinct()
            if name in rounds:
                new = new.join(reduce(DataFrame.unionByName, rounds[name]), list(named[name].primary_key), "left_anti")
            new = keep(new, name)
            if not new.isEmpty():
                fresh[name] = new
        for name, new in fresh.items():
            rounds.setdefault(name, []).append(new)
    return {n: reduce(DataFrame.unionByName, parts) for n, parts in rounds.items()}


def _left(tables, named, name: str, gone: Mapping[str, DataFrame]) -> DataFrame:
    contract, df = named[name], tables[name]
    columns = df.columns
    if name in gone:
        df = df.join(gone[name], list(contract.primary_key), "left_anti").select(*columns)
    for r in contract.references:
        if r.on_delete == "cascade" or r.table not in gone:
            continue
        lost = _named_by(tables, named, r.table, r, gone[r.table]).distinct()
        if r.on_delete == "restrict":
            held = df.join(lost, list(r.columns), "left_semi")
            df = guard_empty(df, held, f"rows of {contract.name} that refer to deleted rows of {r.table}")
        else:
            joined = df.join(lost.withColumn("_lost", F.lit(True)), list(r.columns), "left")
            df = joined.select(*(F.when(F.col("_lost").isNull(), F.col(c)).alias(c) if c in r.columns else c for c in columns))
    return df
