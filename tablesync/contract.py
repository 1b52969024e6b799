"""Declared table contracts: columns, types, nullability, defaults and keys.

A contract is configuration, read once on the driver (a YAML file of a few
kilobytes), and compiled to a Spark ``StructType``. Everything downstream takes
the contract next to a DataFrame; no row ever becomes a Python object.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, time
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.errors import ContractError

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

# Names of declared column types and the Spark type that stores them.
# "timestamp" has no zone (values are UTC); "time" is kept as HH:mm:ss text.
_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "varchar": T.StringType(),
    "uuid": T.StringType(),
    "time": T.StringType(),
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "smallint": T.ShortType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampNTZType(),
    "timestamp without time zone": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "timestamp with time zone": T.TimestampType(),
    "date": T.DateType(),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "double": T.DoubleType(),
    "bytea": T.BinaryType(),
}
_NUMERIC = re.compile(r"(?:numeric|decimal)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)")
_VARCHAR = re.compile(r"(?:varchar|char|character varying)\s*\(\s*\d+\s*\)")


def spark_type(declared: str) -> T.DataType:
    """Spark type for a declared type name, e.g. ``"timestamp"`` or ``"numeric(10,2)"``."""
    name = declared.strip().lower()
    if name in _TYPES:
        return _TYPES[name]
    numeric = _NUMERIC.fullmatch(name)
    if numeric:
        return T.DecimalType(int(numeric[1]), int(numeric[2] or 0))
    if _VARCHAR.fullmatch(name):
        return T.StringType()
    raise ContractError(f"unknown column type {declared!r}")


def check_identifier(value: Any, what: str) -> str:
    if not isinstance(value, str) or not _IDENTIFIER.fullmatch(value.strip()):
        raise ContractError(f"{what} is not a valid identifier: {value!r}")
    return value.strip().lower()


def _plain(value: Any) -> Any:
    return value.isoformat() if isinstance(value, date | datetime | time) else value


def exact_literal(value: object, want: T.DataType) -> Column:
    """A constant in its declared type; one that does not fit fails in any session."""
    literal = F.lit(value)
    if value is None:
        return literal.cast(want)
    message = f"{value!r} is no {want.simpleString()}"
    return F.when(literal.try_cast(want).isNull(), F.raise_error(F.lit(message))).otherwise(literal.try_cast(want))


@dataclass(frozen=True)
class ColumnContract:
    """One declared column. ``domain`` lists the allowed values of an enumeration."""

    name: str
    data_type: str
    comment: str | None = None
    nullable: bool = True
    default: Any = None
    domain: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "name", check_identifier(self.name, "column name"))
        object.__setattr__(self, "data_type", self.data_type.strip().lower())
        object.__setattr__(self, "comment", (self.comment or "").strip() or None)
        object.__setattr__(self, "default", _plain(self.default))
        object.__setattr__(self, "domain", tuple(self.domain))
        spark_type(self.data_type)

    @property
    def type(self) -> T.DataType:
        return spark_type(self.data_type)

    def default_value(self) -> Column:
        """The declared default as a typed literal (NULL when none is declared)."""
        return exact_literal(self.default, self.type)

    def struct_field(self) -> T.StructField:
        notes: dict[str, Any] = {}
        if self.comment:
            notes["comment"] = self.comment
        if self.default is not None:
            notes["default"] = str(self.default)
        return T.StructField(self.name, self.type, self.nullable, notes)


ON_DELETE = ("cascade", "restrict", "set_null")


@dataclass(frozen=True)
class Reference:
    """Columns that name a row of another table, or of the same one, and what happens to a row whose
    parent is deleted. A reference with a NULL part names nothing."""

    columns: tuple[str, ...]
    table: str
    parent_columns: tuple[str, ...]
    on_delete: str = "cascade"

    def __post_init__(self) -> None:
        for name in ("columns", "parent_columns"):
            given = getattr(self, name)
            given = (given,) if isinstance(given, str) else tuple(given)
            object.__setattr__(self, name, tuple(check_identifier(c, "reference column") for c in given))
        object.__setattr__(self, "table", check_identifier(self.table, "referenced table"))
        if not self.columns or len(self.columns) != len(self.parent_columns):
            raise ContractError(f"a reference needs as many columns as it names: {self.columns}, {self.parent_columns}")
        if self.on_delete not in ON_DELETE:
            raise ContractError(f"on_delete must be one of {list(ON_DELETE)}, not {self.on_delete!r}")

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> Reference:
        return cls(raw.get("columns") or (), raw.get("table", ""), raw.get("parent_columns") or raw.get("columns") or (),
                   raw.get("on_delete", "cascade"))


@dataclass(frozen=True)
class TableContract:
    """A table: ordered columns, primary key, and the column lists some operators need.

    ``id_columns`` feed the surrogate key; ``watermark_columns`` are the only
    timestamps that may be advanced by ``watermark_advance``.
    """

    schema_name: str
    table_name: str
    columns: tuple[ColumnContract, ...]
    primary_key: tuple[str, ...] = ()
    comment: str | None = None
    id_columns: tuple[str, ...] = ()
    watermark_columns: tuple[str, ...] = ()
    references: tuple[Reference, ...] = ()
    _by_name: Mapping[str, ColumnContract] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if not self.columns:
            raise ContractError("a contract needs at least one column")
        key = tuple(check_identifier(c, "primary key column") for c in self.primary_key)
        by_name = {c.name: c for c in self.columns}
        if len(by_name) != len(self.columns):
            raise ContractError("column names must be unique")
        unknown = [c for c in key if c not in by_name]
        if unknown:
            raise ContractError(f"primary key columns are not declared: {unknown}")
        absent = [c for r in self.references for c in r.columns if c not in by_name]
        if absent:
            raise ContractError(f"reference columns are not declared: {absent}")
        rest = [c for c in self.columns if c.name not in key]
        object.__setattr__(self, "schema_name", check_identifier(self.schema_name, "schema name"))
        object.__setattr__(self, "table_name", check_identifier(self.table_name, "table name"))
        object.__setattr__(self, "primary_key", key)
        object.__setattr__(self, "columns", (*(by_name[k] for k in key), *rest))
        object.__setattr__(self, "_by_name", by_name)

    # -- loading -----------------------------------------------------------------

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> TableContract:
        columns = raw.get("columns")
        if not isinstance(columns, list) or not columns:
            raise ContractError("'columns' must be a non-empty list")
        key = raw.get("primary_key") or raw.get("primaryKey") or ()
        return cls(
            schema_name=raw.get("schema", ""),
            table_name=raw.get("table", ""),
            comment=(raw.get("comment") or "").strip() or None,
            primary_key=(key,) if isinstance(key, str) else tuple(key),
            id_columns=tuple(raw.get("id_columns") or ()),
            watermark_columns=tuple(raw.get("watermark_columns") or ()),
            references=tuple(map(Reference.from_mapping, raw.get("references") or ())),
            columns=tuple(
                ColumnContract(
                    name=c.get("name", ""),
                    data_type=c.get("data_type", ""),
                    comment=c.get("comment"),
                    nullable=bool(c.get("nullable", True)),
                    default=c.get("default"),
                    domain=tuple(c.get("domain") or ()),
                )
                for c in columns
            ),
        )

    @classmethod
    def from_yaml(cls, path: str | Path, key: str) -> TableContract:
        """Read one block of the ``tables:`` mapping of a YAML file."""
        import yaml

        path = Path(path)
        if path.suffix not in (".yml", ".yaml"):
            raise ContractError(f"expected a .yml or .yaml file, got {path.name}")
        document = yaml.safe_load(path.read_text(encoding="utf-8"))
        tables = document.get("tables") if isinstance(document, dict) else None
        if not isinstance(tables, dict):
            raise ContractError(f"{path.name} has no 'tables' mapping")
        if not isinstance(tables.get(key), dict):
            raise ContractError(f"{path.name} has no table {key!r}; it has {sorted(tables)}")
        return cls.from_mapping(tables[key])

    # -- looking at it -----------------------------------------------------------

    @property
    def name(self) -> str:
        return f"{self.schema_name}.{self.table_name}"

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def required(self) -> list[str]:
        """Columns that may not be NULL: declared NOT NULL, or part of the primary key."""
        return [c.name for c in self.columns if not c.nullable or c.name in self.primary_key]

    def column(self, name: str) -> ColumnContract:
        try:
            return self._by_name[name]
        except KeyError:
            raise ContractError(f"{self.name} has no column {name!r}") from None

    def check_known(self, names: Iterable[str], what: str) -> list[str]:
        names = list(names)
        unknown = sorted(set(names) - set(self._by_name))
        if unknown:
            raise ContractError(f"{what} not in {self.name}: {unknown}")
        return names

    def struct(self) -> T.StructType:
        return T.StructType([c.struct_field() for c in self.columns])

    def create_table_sql(self, using: str = "parquet") -> str:
        """``CREATE TABLE IF NOT EXISTS`` for the Spark catalog."""

        def quoted(text: object) -> str:
            return "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"

        def one(c: ColumnContract) -> str:
            sql = f"`{c.name}` {c.type.simpleString()}"
            if c.name in self.required:
                sql += " NOT NULL"
            if c.default is not None:
                literal = c.default if isinstance(c.default, int | float) else quoted(c.default)
                sql += f" DEFAULT {literal}"
            return sql + (f" COMMENT {quoted(c.comment)}" if c.comment else "")

        body = ",\n  ".join(one(c) for c in self.columns)
        tail = f"\nCOMMENT {quoted(self.comment)}" if self.comment else ""
        return (
            f"CREATE TABLE IF NOT EXISTS `{self.schema_name}`.`{self.table_name}` (\n  {body}\n)"
            f"\nUSING {using}{tail}"
        )


CONTRACT_DIR = Path(__file__).parent / "contracts"


def stored_table(key: str) -> TableContract:
    """One of the shipped contracts, e.g. ``stored_table("accounts")``."""
    return TableContract.from_yaml(CONTRACT_DIR / "tables.yml", key)
