"""Checks that turn data and contracts into rows of violations."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.contract import TableContract
from tablesync.errors import ContractError
from tablesync.functions.keys import enum_valid
from tablesync.operators.guards import any_null, exact_cast, fail_when, lossy

VIOLATIONS = "`column` string, kind string, expected string, actual string, n_bad bigint"


def valid_zones(spark: SparkSession) -> DataFrame:
    """Names in the time-zone database: a fixed list of some 600 short strings, safe to broadcast."""
    names = [(name,) for name in sorted(available_timezones())]
    return F.broadcast(spark.createDataFrame(names, "timezone string"))


def timezone_check(df: DataFrame, column: str = "timezone") -> DataFrame:
    """``df`` with ``zone_valid``."""
    zones = valid_zones(df.sparkSession).withColumnRenamed("timezone", "_zone")
    joined = df.join(zones, df[column] == zones["_zone"], "left")
    return joined.select(*df.columns, F.col("_zone").isNotNull().alias("zone_valid"))


def enum_check(df: DataFrame, column: str, domain: Iterable[str], *, strict: bool = False) -> DataFrame:
    """``df`` with ``enum_valid``; ``strict`` fails on a value outside the domain instead."""
    valid = enum_valid(column, domain)
    if strict:
        value = F.coalesce(F.col(column), F.lit("NULL"))
        return df.where(fail_when(~valid, F.concat(F.lit(f"value of {column} outside its domain: "), value)))
    return df.withColumn("enum_valid", valid)


def default_fill(df: DataFrame, contract: TableContract) -> DataFrame:
    """Contract columns in order, with their notes; an absent column takes its default.

    A column that is present keeps its NULLs. An absent column that is required
    and has no default is an error.
    """
    absent = [c for c in contract.columns if c.name not in df.columns]
    required = [c.name for c in absent if c.name in contract.required and c.default is None]
    if required:
        raise ContractError(f"{contract.name} needs columns {required}")
    missing = {c.name for c in absent}
    return df.select(
        *(
            (c.default_value() if c.name in missing else exact_cast(df, c.name, c.type)).alias(
                c.name, metadata=c.struct_field().metadata
            )
            for c in contract.columns
        )
    )


def pk_integrity(df: DataFrame, contract: TableContract) -> DataFrame:
    """One row per check ``(check, columns, n_bad)``: keys used more than once, and NULLs
    per required column. One aggregation by key serves all checks."""
    key = list(contract.primary_key)
    required = contract.required
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in required),
    )
    repeated = (F.col("_rows") > 1) & ~any_null(key)
    totals = per_key.agg(
        F.count_if(repeated).alias("_repeated"),
        *(F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(f"_null_{c}") for c in required),
    )
    checks = [("duplicate_key", ",".join(key), F.col("_repeated"))]
    checks += [("null", c, F.col(f"_null_{c}")) for c in required]
    return totals.select(_inline(("check", "columns", "n_bad"), checks))


def _inline(names: Sequence[str], rows: Sequence[tuple]) -> Column:
    """Rows of constants and counts out of one row of totals."""
    text = T.StringType()

    def value(v: object) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast(text) if v is None else F.lit(v)

    structs = [F.struct(*(value(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows]
    return F.inline(F.array(*structs)).alias(*names)


@dataclass(frozen=True)
class _Finding:
    """A difference. ``bad`` marks the rows that count toward it; with ``if_any``
    it is only one when some row does."""

    labels: tuple
    bad: Column | None = None
    if_any: bool = False


def _report(df: DataFrame, names: Sequence[str], findings: Sequence[_Finding]) -> DataFrame:
    """Findings with their counts, from one pass over the columns they look at."""
    never = F.lit(False)
    totals = df.agg(*(F.count_if(never if f.bad is None else f.bad).alias(f"_{i}") for i, f in enumerate(findings)))
    rows = [
        (*f.labels, F.col(f"_{i}"), F.col(f"_{i}") > 0 if f.if_any else F.lit(True)) for i, f in enumerate(findings)
    ]
    return totals.select(_inline((*names, "n_bad", "_shown"), rows)).where("_shown").drop("_shown")


def _attached_default(notes: dict) -> str | None:
    """The default a column carries: in this library's note, or as SQL in a catalog table."""
    if "default" in notes:
        return notes["default"]
    sql = notes.get("CURRENT_DEFAULT")
    if sql is not None and len(sql) > 1 and sql[0] == sql[-1] == "'":
        return re.sub(r"\\(.)", r"\1", sql[1:-1])
    return sql


def schema_diff(df: DataFrame | None, contract: TableContract, spark: SparkSession | None = None) -> DataFrame:
    """Differences between a table and its contract, as rows of ``(column, kind, expected,
    actual, n_bad)``; no row means a match.

    Kinds: missing, extra, type, nullable, default, comment. Parquet does not keep
    NOT NULL, so ``nullable`` counts the NULLs actually stored; ``type`` counts the
    values that would not survive the cast. One pass over the differing columns
    answers all of it. ``df=None`` stands for an absent table.
    """
    if df is None:
        if spark is None:
            raise ContractError("an absent table needs the session")
        rows = [(c.name, "missing", c.type.simpleString(), None, 0) for c in contract.columns]
        return spark.createDataFrame(rows, VIOLATIONS)
    live = {f.name.lower(): f for f in df.schema.fields}
    found = [
        _Finding((name, "extra", None, f.dataType.simpleString()))
        for name, f in live.items()
        if name not in contract.column_names
    ]
    for c in contract.columns:
        field = live.get(c.name)
        declared = c.type.simpleString()
        if field is None:
            found.append(_Finding((c.name, "missing", declared, None)))
            continue
        column, notes = F.col(field.name), field.metadata
        if field.dataType != c.type:
            labels = (c.name, "type", declared, field.dataType.simpleString())
            found.append(_Finding(labels, lossy(column, field.dataType, c.type)))
        if c.name in contract.required:
            found.append(_Finding((c.name, "nullable", "not null", "null"), column.isNull(), if_any=True))
        default = None if c.default is None else str(c.default)
        if default != _attached_default(notes):
            found.append(_Finding((c.name, "default", default, _attached_default(notes))))
        if c.comment != notes.get("comment"):
            found.append(_Finding((c.name, "comment", c.comment, notes.get("comment"))))
    names = ("column", "kind", "expected", "actual")
    return _report(df, names, found) if found else df.sparkSession.createDataFrame([], VIOLATIONS)


def diff_verdict(diff: DataFrame) -> DataFrame:
    """One row ``(is_match, is_destructive)``: extra columns and type changes destroy data."""
    return diff.agg(
        (F.count(F.lit(1)) == 0).alias("is_match"),
        (F.count_if(F.col("kind").isin("extra", "type")) > 0).alias("is_destructive"),
    )


def schema_reconcile(df: DataFrame, contract: TableContract) -> DataFrame:
    """The table in contract shape: missing columns added with their default, types cast,
    NOT NULL checked, defaults and comments attached.

    An extra column is refused; a value that does not cast or a NULL that is not
    allowed fails the job, so nothing is half changed.
    """
    extra = sorted({c.lower() for c in df.columns} - set(contract.column_names))
    if extra:
        raise ContractError(f"columns not in {contract.name}: {extra}")
    live = {c.lower(): c for c in df.columns}
    out = df.select(
        *(
            (exact_cast(df, live[c.name], c.type) if c.name in live else c.default_value()).alias(
                c.name, metadata=c.struct_field().metadata
            )
            for c in contract.columns
        )
    )
    for c in contract.required:
        out = out.where(fail_when(F.col(c).isNull(), f"NULL in {contract.name}.{c}, declared NOT NULL"))
    return out


def contract_check(df: DataFrame, contract: TableContract) -> DataFrame:
    """Everything that keeps ``df`` from being this table, as rows of ``(rule, column, detail, n_bad)``.

    Rules: only_in_data, only_in_contract, type, nullable, default (declared, but another
    or none attached to the data), domain, and the key, id and watermark columns the
    contract names but does not declare or the data lacks.
    """
    live = {f.name: f.dataType for f in df.schema.fields}
    notes = {f.name: f.metadata for f in df.schema.fields}
    found = [
        _Finding(("only_in_data", c, live[c].simpleString())) for c in live if c not in contract.column_names
    ]
    for c in contract.columns:
        if c.name not in live:
            found.append(_Finding(("only_in_contract", c.name, c.type.simpleString())))
            continue
        column = F.col(c.name)
        if live[c.name] != c.type:
            detail = f"{live[c.name].simpleString()} for {c.type.simpleString()}"
            found.append(_Finding(("type", c.name, detail), lossy(column, live[c.name], c.type)))
        if c.name in contract.required:
            found.append(_Finding(("nullable", c.name, "NULL where NOT NULL"), column.isNull(), if_any=True))
        declared, attached = None if c.default is None else str(c.default), _attached_default(notes[c.name])
        if declared != attached:
            found.append(_Finding(("default", c.name, f"{attached} for {declared}")))
        if c.domain:
            outside = column.isNotNull() & ~enum_valid(column.cast("string"), c.domain)
            found.append(_Finding(("domain", c.name, "outside " + "|".join(c.domain)), outside, if_any=True))
    if not contract.primary_key:
        found.append(_Finding(("primary_key", None, "none declared")))
    named = {
        "primary_key": contract.primary_key,
        "id_columns": contract.id_columns,
        "watermark_columns": contract.watermark_columns,
    }
    for rule, columns in named.items():
        found += [_Finding((rule, c, "not in the contract")) for c in columns if c not in contract.column_names]
        found += [_Finding((rule, c, "not in the data")) for c in columns if c not in live]
    names = ("rule", "column", "detail")
    empty = "rule string, `column` string, detail string, n_bad bigint"
    return _report(df, names, found) if found else df.sparkSession.createDataFrame([], empty)
