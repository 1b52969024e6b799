"""Faults once found by probing, each with the input that showed it."""

import json
from datetime import datetime

import pytest
from helpers import fails
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync import functions as fn
from tablesync.contract import ColumnContract as C
from tablesync.contract import TableContract, stored_table
from tablesync.operators import contract_check, due_users, merge, schema_diff, top_per_key, update_where
from tablesync.operators.guards import exact_cast
from tablesync.operators.ingest import GAME
from tablesync.operators.ledger import bad_schedules
from tablesync.plans import sync_partitions
from tablesync.sources import landing_load, landing_write

DAYS = TableContract("s", "days", (C("id", "integer", nullable=False), C("day", "text"), C("v", "text")), primary_key=("id",))


def table(spark, path, *rows):
    spark.createDataFrame(rows, "id int, day string, v string").write.partitionBy("day").parquet(path)


def test_sync_keeps_the_null_partition_and_prunes(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, (1, None, "a"), (2, "x", "b"), (3, "y", "c"))
    source = spark.createDataFrame([(7, None, "n"), (8, "x", "n")], "id int, day string, v string")
    assert sync_partitions(path, source, DAYS, "day")["rows_inserted"] == 2
    got = rows(spark.read.schema(DAYS.struct()).parquet(path), "id")
    assert got == [(1,), (2,), (3,), (7,), (8,)]


def test_sync_refuses_a_key_of_another_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    table(spark, path, (1, "a", "old"), (2, "b", "old"))
    moved = spark.createDataFrame([(1, "b", "new")], "id int, day string, v string")
    with fails("held by another partition"):
        sync_partitions(path, moved, DAYS, "day")
    assert spark.read.parquet(path).count() == 2


def test_condition_decides_row_by_row(spark, rows):
    contract = TableContract("s", "t", (C("id", "integer", nullable=False), C("k", "text"), C("v", "integer")), primary_key=("id",))
    target = spark.createDataFrame([(1, "k1", 1)], "id int, k string, v int")
    source = spark.createDataFrame([(10, "k1", 5), (11, "k1", -5)], "id int, k string, v int")
    done = merge(target, source, contract, keys=["k"], condition="_source.v > 0", when_matched="ignore")
    assert rows(done.next_state, "id") == [(1,), (11,)]


@pytest.mark.parametrize(
    ("zone", "hour"), [(" CET", 9), (" EST", 15), (" Japan", 1), (" GMT+3", 7), (" Etc/GMT+5", 15), ("+9:00", 1), ("", 10)]
)
def test_every_spelling_of_a_zone(spark, zone, hour):
    df = spark.createDataFrame([(f"2024-01-15 10:00:00{zone}",)], "t string")
    assert df.select(fn.text_to_utc(F.col("t")).alias("t")).first().t == datetime(2024, 1, 15, hour)


def test_an_unknown_zone_fails(spark):
    df = spark.createDataFrame([("2024-01-15 10:00:00 Mars/Base",)], "t string")
    with fails("CAST_INVALID_INPUT"):
        df.select(fn.text_to_utc(F.col("t"))).collect()


@pytest.mark.parametrize(
    ("value", "have", "want", "survives"),
    [
        ("1.7D", "double", "integer", False), ("2.0D", "double", "integer", True), ("'2024-01-01 05:00'", "string", "date", False),
        ("'2024-01-01'", "string", "date", True), ("'01'", "string", "integer", True), ("9007199254740993", "bigint", "double precision", False),
        ("'1.234'", "string", "numeric(10,2)", False), ("null", "string", "integer", True), ("0.1D", "double", "real", True),
    ],
)
def test_casts_that_lose_fail(spark, value, have, want, survives):
    try:
        dtype = C("x", want).type
    except Exception:  # a type this library does not declare
        pytest.skip(want)
    df = spark.range(1).selectExpr(f"cast({value} as {have}) as x")
    if survives:
        df.select(exact_cast(df, "x", dtype)).collect()
    else:
        with fails("does not cast"):
            df.select(exact_cast(df, "x", dtype)).collect()


def test_constants_are_checked_without_ansi(spark):
    contract = TableContract("s", "t", (C("id", "integer", nullable=False),), primary_key=("id",))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with fails("is no int"):
            update_where(spark.createDataFrame([(1,)], "id int"), {"id": "abc"}, "id = 1", contract).next_state.collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_users_without_a_time_are_not_due(spark, rows):
    users = spark.createDataFrame(
        [("a", None, "UTC"), ("b", "soon", "UTC"), ("c", "03:00:00", "UTC"), ("d", "03:00:00", "Mars")],
        "user_id string, cron_time string, timezone string",
    )
    due = due_users(users, datetime(2024, 1, 1), datetime(2024, 1, 2))
    assert rows(due, "user_id") == [("c",)]
    assert rows(bad_schedules(users), "user_id") == [("a",), ("b",), ("d",)]


def test_landing_by_account_and_day(spark, rows, tmp_path):
    side = {"username": "ann", "rating": 1, "result": "win"}
    texts = [json.dumps({"url": u, "white": side, "black": side}) for u in ("g1", "g2")]
    (tmp_path / "in.jsonl").write_text("\n".join(texts))
    games = spark.read.schema(GAME).json(str(tmp_path / "in.jsonl")).withColumn("account_id", F.concat(F.lit("a"), "url"))
    root = str(tmp_path / "raw")
    for day in ("2024-01-30", "2024-01-31"):
        landing_write(games, root, day, partition_by=("account_id", "ingest_date"))
    loaded = landing_load(spark, root, GAME, since="2024-01-31", until="2024-01-31")
    assert rows(loaded, "account_id", "url") == [("ag1", "g1"), ("ag2", "g2")]
    assert "PartitionFilters: [isnotnull(ingest_date" in loaded._jdf.queryExecution().toString()


def test_landing_of_many_accounts_in_few_folders(spark, rows, tmp_path):
    games = spark.range(300).selectExpr(
        "IF(id = 7, NULL, id) AS account_id", "concat('g', id) AS url", "named_struct('username', 'ann') AS white"
    )
    root = tmp_path / "raw"
    for day in ("2024-01-30", "2024-01-31"):
        landing_write(games, str(root), day, bucket_by="account_id")
    assert 1 < len(list(root.glob("account_id_bucket=*"))) <= 16
    schema = T.StructType([T.StructField("account_id", T.LongType()), *GAME.fields])
    loaded = landing_load(spark, str(root), schema, since="2024-01-31")
    assert rows(loaded, "account_id", "url") == rows(games, "account_id", "url")


def test_landing_query_has_no_folder_per_account(spark):
    from catalog.queries import QUERIES

    loaded = QUERIES["landing_load_since"](spark, "/root/testdata/sf0.01")
    assert loaded.select("account_id").distinct().count() > 100
    assert len({f.rsplit("/", 2)[0] for f in loaded.inputFiles()}) <= 16


def test_catalog_defaults_are_no_difference(spark):
    contract = TableContract(
        "default", "with_defaults", (C("id", "integer"), C("q", "text", default="it's"), C("n", "integer", default=3))
    )
    spark.sql("DROP TABLE IF EXISTS default.with_defaults")
    spark.sql(contract.create_table_sql())
    try:
        assert schema_diff(spark.table("default.with_defaults"), contract).count() == 0
        assert contract_check(spark.table("default.with_defaults"), contract).where("rule = 'default'").count() == 0
    finally:
        spark.sql("DROP TABLE default.with_defaults")


@pytest.mark.parametrize("key", ["users", "accounts", "games", "pipeline_runs", "pipeline_run_steps"])
def test_stored_tables_satisfy_their_contracts(spark, key):
    contract = stored_table(key)
    empty = spark.createDataFrame([], contract.struct())
    assert contract_check(empty, contract).count() == 0


def test_many_rows_per_key_are_limited_in_parts(spark):
    df = spark.range(5000).selectExpr("id", "0 AS k")
    got = top_per_key(df, ["k"], ["id"], 2000)
    assert sorted(r.id for r in got.collect()) == list(range(2000))
