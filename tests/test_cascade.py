"""Deletes along declared references, and rows that refer to nothing."""

import random

import pytest
from helpers import fails

from tablesync import ColumnContract as C
from tablesync import ContractError, Reference, TableContract
from tablesync.operators import cascade_delete, reference_check


def contract(name, key, columns, *references):
    return TableContract("s", name, tuple(C(c, "bigint") for c in columns), key, references=references)


def state(left):
    return {name: sorted(tuple(r) for r in df.collect()) for name, df in left.items()}


USERS = contract("users", ("id",), ["id"])
LINKS = contract("links", ("u", "a"), ["u", "a"], Reference("u", "users", "id"), Reference("a", "accounts", "id"))
ACCOUNTS = contract("accounts", ("id",), ["id", "owner"], Reference("owner", "users", "id", "set_null"))
NOTES = contract("notes", ("id",), ["id", "u", "a"], Reference(("u", "a"), "links", ("u", "a")))
BILLS = contract("bills", ("id",), ["id", "owner"], Reference("owner", "users", "id", "restrict"))


@pytest.fixture
def tables(spark):
    return {
        "users": spark.createDataFrame([(1,), (2,), (3,)], "id long"),
        "accounts": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, owner long"),
        "links": spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12)], "u long, a long"),
        "notes": spark.createDataFrame([(5, 1, 10), (6, 2, 11), (7, None, 10), (8, 1, None)], "id long, u long, a long"),
    }


def test_three_levels_composite_keys_nulls_and_set_null(spark, tables):
    removed = spark.createDataFrame([(1,), (1,), (99,)], "id long")
    left = state(cascade_delete(tables, [NOTES, LINKS, ACCOUNTS, USERS], "users", removed))
    assert left == {
        "users": [(2,), (3,)],
        "accounts": sorted([(10, None), (11, 2), (12, None)]),
        "links": [(2, 11), (3, 12)],
        "notes": [(6, 2, 11), (7, None, 10), (8, 1, None)],
    }


def test_restrict_fails_the_job(spark, tables):
    both = {**tables, "bills": spark.createDataFrame([(1, 2)], "id long, owner long")}
    contracts = [NOTES, LINKS, ACCOUNTS, USERS, BILLS]
    removed = lambda i: spark.createDataFrame([(i,)], "id long")
    assert state(cascade_delete(both, contracts, "users", removed(1)))["bills"] == [(1, 2)]
    with fails("rows of s.bills that refer to deleted rows of users"):
        cascade_delete(both, contracts, "users", removed(2))["bills"].collect()


def test_a_chain_that_refers_to_itself_and_a_ring(spark):
    """Against a plain walk: trees of any depth, cycles included."""
    rng = random.Random(3)
    staff = [(i, rng.choice([None, rng.randrange(1, 80), i - 1]), rng.choice([None, 100 + rng.randrange(20)])) for i in range(1, 80)]
    teams = [(100 + k, rng.choice([None, rng.randrange(1, 80)])) for k in range(20)]
    contracts = [
        contract("staff", ("id",), ["id", "boss", "team"], Reference("boss", "staff", "id"), Reference("team", "teams", "id")),
        contract("teams", ("id",), ["id", "lead"], Reference("lead", "staff", "id")),
    ]
    tables = {
        "staff": spark.createDataFrame(staff, "id long, boss long, team long"),
        "teams": spark.createDataFrame(teams, "id long, lead long"),
    }
    for start in (5, 40, 79):
        gone = {start}
        while True:
            more = {r[0] for r in staff if r[1] in gone or r[2] in gone} | {r[0] for r in teams if r[1] in gone}
            if more <= gone:
                break
            gone |= more
        left = state(cascade_delete(tables, contracts, "staff", spark.createDataFrame([(start,)], "id long")))
        assert [r[0] for r in left["staff"]] == [r[0] for r in staff if r[0] not in gone]
        assert [r[0] for r in left["teams"]] == [r[0] for r in teams if r[0] not in gone]


def test_reference_check_counts_orphans(spark, tables):
    broken = {**tables, "users": tables["users"].where("id <> 3")}
    got = sorted(tuple(r) for r in reference_check(broken, [NOTES, LINKS, ACCOUNTS, USERS]).collect())
    assert got == [("accounts", "owner", "users", 0), ("links", "a", "accounts", 0), ("links", "u", "users", 1), ("notes", "u,a", "links", 0)]


def test_empty_removal_and_empty_tables(spark, tables):
    none = spark.createDataFrame([], "id long")
    assert state(cascade_delete(tables, [NOTES, LINKS, ACCOUNTS, USERS], "users", none)) == state(tables)
    empty = {n: df.limit(0) for n, df in tables.items()}
    assert set(map(tuple, state(cascade_delete(empty, [NOTES, LINKS, ACCOUNTS, USERS], "users", none)).values())) == {()}


def test_declarations_are_checked():
    with pytest.raises(ContractError, match="no contract here"):
        reference_check({}, [LINKS])
    with pytest.raises(ContractError, match="as many columns"):
        Reference(("a", "b"), "t", ("a",))
    with pytest.raises(ContractError, match="on_delete"):
        Reference("a", "t", "a", "ignore")
    with pytest.raises(ContractError, match="not declared"):
        contract("t", ("id",), ["id"], Reference("x", "t", "id"))
    read = TableContract.from_mapping(
        {"schema": "s", "table": "t", "primary_key": "id", "columns": [{"name": "id", "data_type": "bigint"}, {"name": "up", "data_type": "bigint"}],
         "references": [{"columns": ["up"], "table": "t", "parent_columns": ["id"], "on_delete": "set_null"}]}
    )
    assert read.references == (Reference("up", "t", "id", "set_null"),)
