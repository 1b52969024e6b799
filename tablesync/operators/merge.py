"""MERGE as a plan: next state and counts from one tagged set of rows.

Three physical shapes, chosen per call:

``split``
    The source passes the broadcast size check. The target is joined to it in
    place and source rows without a hit are added. The target is not shuffled.
``full_outer``
    A large source on the table's primary key. One exchange per side; the keys
    are unique on both sides, so no key can be hot.
``shuffle_split``
    Any other large source. The split form with shuffled joins: AQE can cut a hot
    target key in a left join, which it cannot in a full outer join, and the
    target keys are made distinct before the anti join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.contract import TableContract
from tablesync.errors import ContractError
from tablesync.functions.keys import as_predicate
from tablesync.operators.guards import duplicate_keys, exact_cast, guard_empty, guard_not_null, key_set
from tablesync.operators.outcome import ACTION, DELETE, INSERT, KEEP, UPDATE, WriteOutcome, tag
from tablesync.session import fits_broadcast

_HIT = "_hit"
_HELD = "_held"
SHAPES = ("auto", "split", "full_outer", "shuffle_split")


def supplied_columns(
    source: DataFrame,
    contract: TableContract,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
) -> list[str]:
    """The source columns a write uses, in contract order; key columns always."""
    if include is not None and exclude is not None:
        raise ContractError("give include_columns or exclude_columns, not both")
    contract.check_known(source.columns, "source columns")
    names = set(source.columns)
    if include is not None:
        names = set(contract.check_known(include, "include_columns"))
    if exclude is not None:
        names -= set(contract.check_known(exclude, "exclude_columns"))
    names |= set(contract.primary_key)
    absent = sorted(names - set(source.columns))
    if absent:
        raise ContractError(f"source has no columns {absent}")
    return [c for c in contract.column_names if c in names]


def typed(df: DataFrame, contract: TableContract, columns: Sequence[str]) -> DataFrame:
    return df.select(*(exact_cast(df, c, contract.column(c).type).alias(c) for c in columns))


def with_defaults(df: DataFrame, contract: TableContract) -> DataFrame:
    """All contract columns in order; those absent from ``df`` take their default."""
    present = set(df.columns)
    return df.select(
        *(
            (exact_cast(df, c.name, c.type) if c.name in present else c.default_value()).alias(c.name)
            for c in contract.columns
        )
    )


def absent_from(source: DataFrame, target: DataFrame, keys: list[str], *, unique_target: bool) -> DataFrame:
    """Source rows whose key is not in the target."""
    held = target.select(*keys)
    if fits_broadcast(source):
        # Keys that both sides hold are few where the source is small: the target stays in
        # place and the next join can take whichever form suits their measured number.
        hits = held.join(source.select(*keys), keys, "left_semi")
        return source.join(hits if unique_target else hits.distinct(), keys, "left_anti")
    if unique_target:
        return source.join(held, keys, "left_anti")
    # AQE merges partitions by their compressed size. Keys compress so well that a merged partition sorts and hashes
    # some fifty times as much; a number given by hand keeps the partitions as they are. No cut of a hot key is lost:
    # the other side is grouped, and such a join is never cut. An anti join would slip below the repartition.
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = _HELD
    while mark.lower() in {c.lower() for c in source.columns}:
        mark = f"_{mark}"
    held = key_set(target, keys).withColumn(mark, F.lit(True))
    return source.repartition(parts, *keys).join(held, keys, "left").where(F.col(mark).isNull()).drop(mark)


def merge(
    target: DataFrame,
    source: DataFrame,
    contract: TableContract,
    *,
    keys: Sequence[str] | None = None,
    when_matched: str = "update",
    when_not_matched_by_target: str = "insert",
    when_not_matched_by_source: str = "ignore",
    condition: Column | str | None = None,
    include_columns: Iterable[str] | None = None,
    exclude_columns: Iterable[str] | None = None,
    shape: str = "auto",
    validate: bool = True,
) -> WriteOutcome:
    """Merge ``source`` into ``target``.

    ``keys`` default to the primary key; a NULL key matches nothing. A matched
    row takes the supplied source columns, NULLs included; an inserted row takes
    declared defaults for the rest. ``condition`` may refer to ``_target`` and
    ``_source``. An empty source changes nothing, also for a full sync; that is
    the one question answered while the plan is built.

    ``validate=False`` leaves out the duplicate-key checks, for a source that is
    already unique.
    """
    _check_choice("when_matched", when_matched, ("update", "delete", "ignore"))
    _check_choice("when_not_matched_by_target", when_not_matched_by_target, ("insert", "ignore"))
    _check_choice("when_not_matched_by_source", when_not_matched_by_source, ("delete", "ignore"))
    _check_choice("shape", shape, SHAPES)
    keys = contract.check_known(keys or contract.primary_key, "merge keys")
    if not keys:
        raise ContractError("a merge needs keys or a primary key")
    names = supplied_columns(source, contract, include_columns, exclude_columns)
    if set(keys) - set(names):
        raise ContractError(f"source lacks merge keys {sorted(set(keys) - set(names))}")

    changed = [c for c in names if c not in keys]
    inserting = when_not_matched_by_target == "insert"
    on_match = {"update": UPDATE if changed else KEEP, "delete": DELETE, "ignore": KEEP}[when_matched]
    if on_match == KEEP and not inserting and when_not_matched_by_source == "ignore":
        raise ContractError("this merge has no action")

    columns = contract.column_names
    target = target.select(*columns)
    source = typed(source, contract, names)
    on_key = set(keys) == set(contract.primary_key)
    if condition is not None:
        condition = as_predicate(condition, "merge condition")
    on_target_only = KEEP
    if when_not_matched_by_source == "delete" and not source.isEmpty():
        on_target_only = DELETE
    # A target row may not be changed twice. Repeats that match a row left alone are harmless.
    needs_unique = on_match == UPDATE or (on_match == DELETE and inserting)
    if validate and needs_unique:
        source = guard_empty(source, duplicate_keys(source, keys), f"duplicate source keys for {contract.name}")

    if shape == "auto":
        small = fits_broadcast(source)
        # Next to a small target there is no shuffle to save, and one join is fewer jobs.
        if on_key and (not small or fits_broadcast(target)):
            shape = "full_outer"
        else:
            shape = "split" if small else "shuffle_split"
    parts = (target, source, contract, keys, changed, on_match, on_target_only)
    state = None
    if shape == "full_outer" and on_key and inserting and needs_unique and condition is None:
        tagged = _full_outer(*parts)
        if on_target_only == DELETE:
            state = _full_outer(*parts, source_only=True)
    else:
        tagged = _matched_side(*parts, condition, needs_unique)
        if inserting:
            new = with_defaults(_unmatched_source(target, source, keys, condition, on_key), contract)
            if validate and contract.primary_key:
                new = _guard_new_keys(new, tagged, contract, needs_unique, on_key and condition is None)
            tagged = tagged.unionByName(tag(new, INSERT))

    if validate and on_match == UPDATE and set(changed) & set(contract.primary_key):
        # Matching on other columns may rewrite keys: check them all.
        live = tagged.where(F.col(ACTION) != DELETE)
        clashes = duplicate_keys(live, list(contract.primary_key))
        tagged = guard_empty(tagged, clashes, f"primary key clash in {contract.name}")

    touched = F.col(ACTION).isin(INSERT, UPDATE)
    tagged = guard_not_null(tagged, contract.required, contract.name, touched)
    replaced = on_target_only == DELETE and on_match == UPDATE and inserting and on_key and condition is None
    if replaced and names == columns:
        # Every value of the next state comes from the source.
        state = source
    if state is not None:
        state = guard_not_null(state, contract.required, contract.name)
    return WriteOutcome("merge", tagged, tuple(columns), () if on_key else tuple(keys), state)


def _check_choice(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ContractError(f"{name} must be one of {list(allowed)}, not {value!r}")


def _on(keys: list[str], condition: Column | None) -> Column:
    on = reduce(and_, (F.col(f"_target.{k}") == F.col(f"_source.{k}") for k in keys))
    return on if condition is None else on & condition


def _join(target: DataFrame, source: DataFrame, keys: list[str], condition: Column | None, how: str) -> DataFrame:
    return target.alias("_target").join(source.alias("_source"), _on(keys, condition), how)


def _matched_side(
    target, source, contract, keys, changed, on_match, on_target_only, condition, unique_source
) -> DataFrame:
    """Every target row, tagged."""
    if on_match == on_target_only == KEEP:
        return tag(target, KEEP)
    if on_match != UPDATE and not unique_source:
        # Repeated source keys must not multiply rows. A branch whose rows go is only
        # run when they are counted.
        hits = _join(target, source, keys, condition, "left_semi")
        rest = _join(target, source, keys, condition, "left_anti")
        return tag(hits, on_match).unionByName(tag(rest, on_target_only))
    joined = _join(target, source.withColumn(_HIT, F.lit(1)), keys, condition, "left")
    hit = F.col(_HIT).isNotNull()
    from_source = set(changed) if on_match == UPDATE else set()
    return joined.select(
        *(
            (
                F.when(hit, F.col(f"_source.{c}")).otherwise(F.col(f"_target.{c}"))
                if c in from_source
                else F.col(f"_target.{c}")
            ).alias(c)
            for c in contract.column_names
        ),
        F.when(hit, F.lit(on_match)).otherwise(F.lit(on_target_only)).alias(ACTION),
    )


def _unmatched_source(target, source, keys, condition, on_key) -> DataFrame:
    if condition is None:
        return absent_from(source, target, keys, unique_target=on_key)
    # The condition looks at a pair of rows, so a row is unmatched when no pair of its own fits.
    return source.alias("_source").join(target.alias("_target"), _on(keys, condition), "left_anti")


def _full_outer(
    target, source, contract, keys, changed, on_match, on_target_only, source_only=False
) -> DataFrame:
    """All rows, tagged; with ``source_only`` just those a full sync leaves, untagged."""
    joined = _join(
        target.withColumn(_HELD, F.lit(1)), source.withColumn(_HIT, F.lit(1)), keys, None, "full_outer"
    )
    held, hit = F.col(_HELD).isNotNull(), F.col(_HIT).isNotNull()
    from_source = hit if on_match == UPDATE else hit & ~held
    if source_only:
        # Dropping target-only rows here lets the optimizer narrow the outer join.
        joined = joined.where(from_source)

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"_target.{c}"), F.col(f"_source.{c}"))
        if c in changed:
            return F.when(from_source, F.col(f"_source.{c}")).otherwise(F.col(f"_target.{c}"))
        return F.when(held, F.col(f"_target.{c}")).otherwise(contract.column(c).default_value())

    action = (
        F.when(held & hit, F.lit(on_match)).when(hit, F.lit(INSERT)).otherwise(F.lit(on_target_only))
    )
    tags = () if source_only else (action.alias(ACTION),)
    return joined.select(*(value(c).alias(c) for c in contract.column_names), *tags)


def _guard_new_keys(new, kept, contract, unique_source, unmatched_on_key) -> DataFrame:
    """The key check on the result: a new row may share its key with no other row."""
    key = list(contract.primary_key)
    if unmatched_on_key:
        # The anti join ruled out the target, and a unique source rules out the rest.
        if unique_source:
            return new
        clashes = new.select(*key)
    else:
        live = kept.where(F.col(ACTION) != DELETE).select(*key)
        clashes = new.select(*key).unionByName(live.join(new.select(*key), key, "left_semi"))
    return guard_empty(new, duplicate_keys(clashes, key), f"primary key clash in {contract.name}")


def watermark_advance(
    target: DataFrame,
    advanced: DataFrame,
    contract: TableContract,
    column: str,
    **options,
) -> WriteOutcome:
    """Set one ``latest_*`` column for the keys in ``advanced``, nothing else.

    ``advanced`` holds the key and the run's start, taken before the fetch, for
    the accounts that had records. Only columns the contract allows may move.
    """
    if column not in contract.watermark_columns:
        raise ContractError(f"{column!r} may not be advanced; allowed: {list(contract.watermark_columns)}")
    return merge(
        target,
        advanced.select(*contract.primary_key, column),
        contract,
        when_not_matched_by_target="ignore",
        **options,
    )
