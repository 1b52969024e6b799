import pytest
from pyspark.sql import functions as F
from helpers import fails

from tablesync import ColumnContract as C
from tablesync import ContractError, TableContract, stored_table
from tablesync.operators import (
    contract_check,
    default_fill,
    diff_verdict,
    enum_check,
    pk_integrity,
    schema_diff,
    schema_reconcile,
    timezone_check,
)

TABLE = TableContract(
    "s",
    "t",
    (
        C("id", "integer", nullable=False),
        C("n", "integer"),
        C("tier", "text", nullable=False, default="Free", domain=("Free", "Premium")),
        C("note", "text", comment="Remark"),
    ),
    primary_key=("id",),
)


def live(spark, data, schema="id int, n string, tier string, extra int"):
    return spark.createDataFrame(data, schema)


def test_schema_diff(spark, rows):
    df = live(spark, [(1, "5", "Free", 0), (2, "x", None, 0), (3, None, "Premium", 0)])
    diff = schema_diff(df, TABLE)
    assert rows(diff) == [
        ("extra", "extra", None, "int", 0),
        ("n", "type", "int", "string", 1),
        ("note", "missing", "string", None, 0),
        ("tier", "default", "Free", None, 0),
        ("tier", "nullable", "not null", "null", 1),
    ]
    assert tuple(diff_verdict(diff).first()) == (False, True)


def test_absent_table_misses_every_column(spark, rows):
    diff = schema_diff(None, TABLE, spark)
    assert rows(diff, "column", "kind") == [(c, "missing") for c in ("id", "n", "note", "tier")]
    assert tuple(diff_verdict(diff).first()) == (False, False)


def test_reconcile_makes_the_diff_empty(spark, rows, tmp_path):
    df = live(spark, [(1, "5", "Premium")], "id int, n string, tier string")
    fixed = schema_reconcile(df, TABLE)
    assert rows(fixed) == [(1, 5, "Premium", None)]
    fixed.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))  # comments and defaults survive Parquet
    assert schema_diff(stored, TABLE).count() == 0
    assert tuple(diff_verdict(schema_diff(stored, TABLE)).first()) == (True, False)
    assert rows(schema_reconcile(live(spark, [(1,)], "ID int"), TABLE)) == [(1, None, "Free", None)]


def test_reconcile_refusals(spark):
    with pytest.raises(ContractError, match="extra"):
        schema_reconcile(live(spark, [(1, "5", "Free", 0)]), TABLE)
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with fails("n does not cast to int: x"):
            schema_reconcile(live(spark, [(1, "x")], "id int, n string"), TABLE).collect()
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with fails("NOT NULL"):
        schema_reconcile(live(spark, [(1, None)], "id int, tier string"), TABLE).collect()


def test_contract_check(spark, rows):
    df = live(spark, [(1, "5", "Free", 0), (2, "x", "Gold", 0), (None, None, None, 0)])
    assert rows(contract_check(df, TABLE)) == [
        ("default", "tier", "None for Free", 0),
        ("domain", "tier", "outside Free|Premium", 1),
        ("nullable", "id", "NULL where NOT NULL", 1),
        ("nullable", "tier", "NULL where NOT NULL", 1),
        ("only_in_contract", "note", "string", 0),
        ("only_in_data", "extra", "int", 0),
        ("type", "n", "string for int", 1),
    ]
    good = schema_reconcile(live(spark, [(1, "5")], "id int, n string"), TABLE)
    assert contract_check(good, TABLE).count() == 0


def test_contract_check_reports_key_lists(spark, rows):
    loose = TableContract("s", "t", (C("a", "text"),), id_columns=("zz",), watermark_columns=("a",))
    df = spark.createDataFrame([("x",)], "a string")
    assert rows(contract_check(df, loose), "rule", "column", "detail") == [
        ("id_columns", "zz", "not in the contract"),
        ("id_columns", "zz", "not in the data"),
        ("primary_key", None, "none declared"),
    ]


def test_a_user_record_satisfies_its_contract(spark):
    users = stored_table("users")
    given = spark.createDataFrame([("u", "s", "google")], "user_id string, sub string, provider string")
    df = default_fill(given, users)
    assert contract_check(df, users).count() == 0
    row = df.first()
    assert (row.tier, row.email_verified, row.cron_time, row.timezone, row.email) == (
        "Free",
        False,
        "03:00:00",
        "Europe/Amsterdam",
        None,
    )


def test_default_fill_keeps_explicit_nulls_and_wants_required_columns(spark):
    df = spark.createDataFrame([(1, None)], "id int, tier string")
    assert default_fill(df, TABLE).first().tier is None
    with pytest.raises(ContractError, match="id"):
        default_fill(df.drop("id"), TABLE)


def test_pk_integrity(spark, rows):
    df = live(spark, [(1, "a", "Free", 0)] * 3 + [(2, "b", None, 0), (None, "c", "Free", 0), (None, "d", "Free", 0)])
    assert rows(pk_integrity(df, TABLE)) == [
        ("duplicate_key", "id", 1),
        ("null", "id", 2),
        ("null", "tier", 1),
    ]
    assert rows(pk_integrity(df.limit(0), TABLE), "n_bad") == [(0,), (0,), (0,)]


def test_enum_and_zone_checks(spark, rows):
    df = spark.createDataFrame([("Lichess",), ("Elsewhere",), (None,)], "platform string")
    domain = stored_table("accounts").column("platform").domain
    assert rows(enum_check(df, "platform", domain)) == [(None, False), ("Elsewhere", False), ("Lichess", True)]
    with fails("Elsewhere"):
        enum_check(df.where("platform IS NOT NULL"), "platform", domain, strict=True).collect()
    assert enum_check(df.limit(1), "platform", domain, strict=True).count() == 1
    zones = spark.createDataFrame([("Europe/Amsterdam",), ("Mars/Olympus",), (None,)], "timezone string")
    assert rows(timezone_check(zones)) == [(None, False), ("Europe/Amsterdam", True), ("Mars/Olympus", False)]


def test_reading_parquet_loses_not_null_so_it_is_counted(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, n string")
    df.write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).schema["id"].nullable
    assert schema_diff(df.select(F.lit(None).cast("int").alias("id")), TABLE).where("kind = 'nullable'").count() == 1
