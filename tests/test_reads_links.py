import pytest
from pyspark.sql import functions as F
from helpers import fails

from tablesync import PredicateError, stored_table
from tablesync.operators import (
    account_list,
    accounts_for_user,
    concat_batches,
    keyed_lookup,
    keys_exist,
    link_add,
    link_remove,
    live_links,
    orphan_accounts,
    row_count,
    row_exists,
    stale_links,
    table_read,
    unlink_cascade,
)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "b", 5), (2, None, 6), (3, "a", 7)], "id int, name string, v int")


@pytest.fixture
def accounts(spark):
    return spark.createDataFrame(
        [
            ("a1", "ann", "Lichess", None),
            ("a2", "  ", "Lichess", None),
            ("a3", " bob ", "Chess.com", "2024-01-02 03:04:05"),
        ],
        "account_id string, username string, platform string, latest_ingestion string",
    ).withColumn("latest_ingestion", F.col("latest_ingestion").cast("timestamp_ntz"))


@pytest.fixture
def bridge(spark):
    return spark.createDataFrame(
        [("u1", "a3"), ("u1", "a1"), ("u1", "gone"), ("u2", "a1")], "user_id string, account_id string"
    )


def test_table_read(people):
    got = table_read(people, ["id"], '"v" > 4', ["name"]).collect()
    assert [r.id for r in got] == [3, 1, 2]  # sorted by an unselected column, NULLs last
    assert [r.id for r in table_read(people, order_by=F.col("v").desc(), limit=1).collect()] == [3]
    assert table_read(people, limit=0).count() == 0
    assert table_read(people).columns == people.columns


def test_counts_and_existence(people, rows, spark):
    assert row_count(people).first().n_rows == 3
    assert row_count(people, "name IS NULL").first().n_rows == 1
    assert row_exists(people, "v = 7").first().found is True
    assert row_exists(people, "v = 8").first().found is False
    for check in (row_count, row_exists):
        with pytest.raises(PredicateError):
            check(people, "  ")
    asked = spark.createDataFrame([(1,), (9,), (9,)], "id int")
    assert rows(keys_exist(asked, people, ["id"])) == [(1, True), (9, False)]


def test_keyed_lookup(spark, rows):
    target = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id int, name string")
    asked = spark.createDataFrame([(1,), (2,), (3,), (1,)], "id int")
    assert rows(keyed_lookup(asked, target, "id", ["name"])) == [
        (1, 1, "ok", "x"),
        (2, 2, "ambiguous", None),
        (3, 0, "missing", None),
    ]
    assert rows(keyed_lookup(asked.where("id = 1"), target, "id", ["name"], strict=True)) == [(1, 1, "ok", "x")]
    for key in (2, 3):
        with fails(f"no unique row for key {key}"):
            keyed_lookup(asked.where(F.col("id") == key), target, "id", strict=True).collect()


def test_concat(spark, rows):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2,)], "a int")
    assert rows(concat_batches([a, b, a])) == [(1, "x"), (1, "x"), (2, None)]
    with pytest.raises(ValueError):
        concat_batches([])


def test_links(spark, rows, accounts, bridge):
    found = accounts_for_user(bridge, accounts, ordered=True).collect()
    assert [(r.user_id, r.account_id) for r in found] == [("u1", "a1"), ("u1", "a3"), ("u2", "a1")]
    only = spark.createDataFrame([("u2",)], "user_id string")
    assert rows(accounts_for_user(bridge, accounts, only), "user_id", "account_id") == [("u2", "a1")]
    assert rows(stale_links(bridge, accounts)) == [("u1", "gone")]
    assert live_links(bridge, accounts).count() == 3
    assert rows(orphan_accounts(accounts, bridge), "account_id") == [("a2",)]


def test_unlink_cascade(spark, rows, bridge):
    users = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "user_id string")
    links, left = unlink_cascade(bridge, users, users.where("user_id = 'u1'"))
    assert rows(links) == [("u2", "a1")]
    assert rows(left) == [("u2",), ("u3",)]


def test_link_add_reports_the_link_not_the_account(spark, rows, accounts, bridge):
    asked = spark.createDataFrame(
        [("u2", "a1"), ("u2", "a3"), ("u2", "new"), ("u2", "new")], "user_id string, account_id string"
    ).select("*", F.lit("name").alias("username"), F.lit("Lichess").alias("platform"))
    contracts = stored_table("accounts"), stored_table("br_users_accounts")
    new_accounts, new_links, report = link_add(asked, accounts, bridge, *contracts)
    assert rows(report) == [("u2", "a1", False), ("u2", "a3", True), ("u2", "new", True)]
    assert rows(new_accounts.next_state, "account_id", "username") == [
        ("a1", "ann"),
        ("a2", "  "),
        ("a3", " bob "),
        ("new", "name"),
    ]
    assert new_links.next_state.count() == bridge.count() + 2


def test_link_remove(spark, rows, bridge):
    gone = spark.createDataFrame([("u1", "a1"), ("u1", "gone")], bridge.schema)
    assert rows(link_remove(bridge, gone)) == [("u1", "a3"), ("u2", "a1")]
    with fails("no such link"):
        link_remove(bridge, spark.createDataFrame([("u2", "a3")], bridge.schema)).collect()


def test_account_list(rows, accounts):
    assert rows(account_list(accounts)) == [
        ("a1", "ann", "Lichess - ann", "Never"),
        ("a3", "bob", "Chess.com - bob", "2024-01-02 03:04:05"),
    ]
