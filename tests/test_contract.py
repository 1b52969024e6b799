import pytest
from pyspark.sql import types as T

from tablesync import ColumnContract, ContractError, TableContract, stored_table
from tablesync.contract import spark_type

KEYS = ("users", "accounts", "br_users_accounts", "pipeline_runs", "pipeline_run_steps", "games")


@pytest.mark.parametrize("key", KEYS)
def test_shipped_contracts_load(key):
    contract = stored_table(key)
    assert contract.primary_key
    assert contract.column_names[: len(contract.primary_key)] == list(contract.primary_key)
    contract.check_known(contract.id_columns, "id columns")
    contract.check_known(contract.watermark_columns, "watermark columns")


def test_users_types_defaults_and_nullability():
    users = stored_table("users")
    struct = users.struct()
    assert struct["email_verified"].dataType == T.BooleanType()
    assert struct["latest_login"].dataType == T.TimestampNTZType()
    assert struct["cron_time"].dataType == T.StringType()
    assert struct["tier"].metadata["default"] == "Free"
    assert not struct["tier"].nullable and struct["email"].nullable
    assert users.required == ["user_id", "sub", "provider", "email_verified", "tier", "cron_time", "timezone"]


def test_names_are_normalised_and_keys_move_to_the_front():
    contract = TableContract.from_mapping(
        {
            "schema": "S",
            "table": "T",
            "primaryKey": "B",
            "columns": [{"name": " A ", "data_type": " TEXT "}, {"name": "b", "data_type": "Integer"}],
        }
    )
    assert contract.name == "s.t"
    assert contract.column_names == ["b", "a"]
    assert contract.required == ["b"]


@pytest.mark.parametrize(
    "raw",
    [
        {"schema": "s", "table": "t", "columns": []},
        {"schema": "s", "table": "t"},
        {"schema": "s", "table": "t", "columns": [{"name": "1a", "data_type": "text"}]},
        {"schema": "s", "table": "t", "columns": [{"name": "a", "data_type": ""}]},
        {"schema": "s", "table": "t", "columns": [{"name": "a", "data_type": "mystery"}]},
        {"schema": "s", "table": "t", "primary_key": ["z"], "columns": [{"name": "a", "data_type": "text"}]},
        {"schema": "s s", "table": "t", "columns": [{"name": "a", "data_type": "text"}]},
        {"schema": "s", "table": "t", "columns": [{"name": n, "data_type": "text"} for n in "aA"]},
    ],
)
def test_bad_contracts_are_refused(raw):
    with pytest.raises(ContractError):
        TableContract.from_mapping(raw)


def test_yaml_errors(tmp_path):
    good = tmp_path / "a.yml"
    good.write_text("tables: {x: {schema: s, table: t, columns: [{name: a, data_type: text}]}}")
    assert TableContract.from_yaml(good, "x").column_names == ["a"]
    with pytest.raises(ContractError, match="no table 'y'"):
        TableContract.from_yaml(good, "y")
    with pytest.raises(ContractError, match="yml"):
        TableContract.from_yaml(tmp_path / "a.json", "x")
    bad = tmp_path / "b.yaml"
    bad.write_text("- 1")
    with pytest.raises(ContractError, match="mapping"):
        TableContract.from_yaml(bad, "x")


@pytest.mark.parametrize(
    ("declared", "expected"),
    [
        ("TIMESTAMP without time zone", T.TimestampNTZType()),
        ("numeric(12, 3)", T.DecimalType(12, 3)),
        ("varchar(20)", T.StringType()),
        ("time", T.StringType()),
    ],
)
def test_type_names(declared, expected):
    assert spark_type(declared) == expected


def test_ddl_runs_in_the_catalog(spark):
    contract = TableContract(
        "ddl_check",
        "things",
        (
            ColumnContract("id", "bigint", nullable=False),
            ColumnContract("tier", "text", default="it's", comment="Tier"),
            ColumnContract("ok", "boolean", default=False),
        ),
        primary_key=("id",),
        comment="Things",
    )
    spark.sql("CREATE SCHEMA IF NOT EXISTS ddl_check")
    try:
        spark.sql(contract.create_table_sql())
        spark.sql(contract.create_table_sql())
        spark.sql("INSERT INTO ddl_check.things (id) VALUES (1)")
        assert [tuple(r) for r in spark.table("ddl_check.things").collect()] == [(1, "it's", False)]
    finally:
        spark.sql("DROP SCHEMA ddl_check CASCADE")
