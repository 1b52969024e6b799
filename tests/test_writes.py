import pytest
from pyspark.sql import functions as F
from helpers import fails

from tablesync import ColumnContract as C
from tablesync import ContractError, PredicateError, TableContract
from tablesync.operators import (
    append_strict,
    dedupe_by_key,
    delete_where,
    insert_ignore,
    merge,
    overwrite,
    update_where,
)
from tablesync.plans import sync_partitions, table_transform

TABLE = TableContract(
    "s",
    "t",
    (C("k", "integer", nullable=False), C("a", "text"), C("n", "integer", nullable=False, default=5)),
    primary_key=("k",),
)
ALL = "k int, a string, n int"


def written(inserted, updated, deleted):
    return {"strategy": "merge", "rows_inserted": inserted, "rows_updated": updated, "rows_deleted": deleted}


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "one", 1), (2, "two", 2), (3, None, 3)], ALL)


def counts(outcome):
    return tuple(outcome.metrics.first())


def test_append(spark, rows, target):
    done = append_strict(target, spark.createDataFrame([(4, "d")], "k int, a string"), TABLE)
    assert rows(done.next_state) == [*rows(target), (4, "d", 5)]
    assert counts(done) == ("append", 1, 0, 0)
    nothing = append_strict(target, spark.createDataFrame([], "k int, a string"), TABLE)
    assert rows(nothing.next_state) == rows(target)


@pytest.mark.parametrize("keys", [[4, 4], [1, 4]])
def test_append_clash_fails_all_of_it(spark, target, keys):
    batch = spark.createDataFrame([(k,) for k in keys], "k int")
    with fails("primary key clash"):
        append_strict(target, batch, TABLE).next_state.collect()


def test_append_null_key_fails(spark, target):
    with fails("NOT NULL"):
        append_strict(target, spark.createDataFrame([(None,)], "k int"), TABLE).next_state.collect()


def test_insert_ignore(spark, rows, target):
    batch = spark.createDataFrame([(2, "x", 9), (4, "b", 2), (4, "a", 1), (4, "c", 0)], ALL)
    done = insert_ignore(target, batch, TABLE, order_by=["n", "a"])
    assert rows(done.next_state) == [*rows(target), (4, "c", 0)]
    assert counts(done) == ("insert_ignore", 1, 0, 0)
    again = insert_ignore(done.next_state, batch, TABLE, order_by=["n", "a"])
    assert rows(again.next_state) == rows(done.next_state)
    assert counts(again) == ("insert_ignore", 0, 0, 0)
    with fails("duplicate source keys"):
        insert_ignore(target, batch, TABLE).next_state.collect()


def test_dedupe_first_latest_and_null_keys(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, 2), (2, 5)], "k int, v int")
    assert rows(dedupe_by_key(df, ["k"], ["v"])) == [(None, 1), (None, 2), (1, 1), (2, 5)]
    assert rows(dedupe_by_key(df, ["k"], [F.col("v").desc()])) == [(None, 1), (None, 2), (1, 2), (2, 5)]


def test_overwrite(spark, rows):
    done = overwrite(spark.createDataFrame([(9, "n")], "k int, a string"), TABLE)
    assert rows(done.next_state) == [(9, "n", 5)]
    assert counts(done) == ("overwrite", 1, 0, 0)
    assert overwrite(spark.createDataFrame([], "k int"), TABLE).next_state.count() == 0
    with fails("primary key clash"):
        overwrite(spark.createDataFrame([(9,), (9,)], "k int"), TABLE).next_state.collect()


def test_update_where(rows, target):
    done = update_where(target, {"a": None, "n": 0}, F.col("n") >= 2, TABLE)
    assert rows(done.next_state) == [(1, "one", 1), (2, None, 0), (3, None, 0)]
    assert counts(done) == ("update_where", 0, 2, 0)
    # A predicate that is NULL for a row leaves the row alone.
    assert counts(update_where(target, {"n": 0}, "a <> 'one'", TABLE)) == ("update_where", 0, 1, 0)
    # The predicate sees the old values of every column.
    swapped = update_where(target, {"a": "z", "n": 8}, "\"a\" = 'one' AND n = 1", TABLE)
    assert rows(swapped.next_state)[0] == (1, "z", 8)


def test_update_where_refusals(target):
    for blank in ("", "   ", None):
        with pytest.raises(PredicateError):
            update_where(target, {"n": 0}, blank, TABLE)
        with pytest.raises(PredicateError):
            delete_where(target, blank)
    with pytest.raises(ContractError):
        update_where(target, {}, "k = 1", TABLE)
    with pytest.raises(ContractError):
        update_where(target, {"nope": 1}, "k = 1", TABLE)
    with fails("NOT NULL"):
        update_where(target, {"n": None}, "k = 1", TABLE).next_state.collect()
    assert update_where(target, {"n": None}, "k = 99", TABLE).next_state.count() == 3


def test_delete_where_keeps_rows_with_a_null_predicate(rows, target):
    done = delete_where(target, "a <> 'one'")
    assert rows(done.next_state, "k") == [(1,), (3,)]
    assert counts(done) == ("delete_where", 0, 0, 1)


def test_write_counts_rows_while_writing(spark, rows, target, tmp_path):
    source = spark.createDataFrame([(2, "b"), (7, "g")], "k int, a string")
    path = str(tmp_path / "next")
    done = merge(target, source, TABLE, when_not_matched_by_source="delete").write(path)
    assert done == written(1, 1, 2)
    assert rows(spark.read.parquet(path)) == [(2, "b", 2), (7, "g", 5)]
    by_name = merge(
        target, source.where("k = 2").withColumn("a", F.lit("two")), TABLE, keys=["a"], when_matched="delete",
        when_not_matched_by_target="ignore",
    ).write(str(tmp_path / "other"))
    assert by_name == written(0, 0, 1)


def test_partitioned_write_gathers_rows_and_counts_once(spark, rows, tmp_path):
    table = TableContract("s", "p", (C("k", "bigint"), C("day", "text")), ("k",))
    target = spark.range(0, 900, 1, 9).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("day"))
    source = spark.range(890, 910).select(F.col("id").alias("k"), F.lit("2").alias("day"))
    path = tmp_path / "t"
    done = merge(target, source, table).write(str(path), partition_by=["day"])
    assert done == written(10, 10, 0)
    assert spark.read.parquet(str(path)).count() == 910
    assert all(len(list((path / f"day={d}").glob("*.parquet"))) == 1 for d in range(3))


def test_sync_partitions_rewrites_only_what_it_touches(spark, rows, tmp_path):
    table = TableContract(
        "s", "p", (C("k", "integer", nullable=False), C("a", "text"), C("day", "text", nullable=False)), ("k",)
    )
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2")], table.struct())
    base.coalesce(1).write.partitionBy("day").parquet(path)
    untouched = sorted(p.name for p in (tmp_path / "t" / "day=d2").glob("*.parquet"))
    new = spark.createDataFrame([(2, "B", "d1"), (4, "d", "d3")], table.struct())
    for expected in (written(1, 1, 0), written(0, 2, 0)):
        assert sync_partitions(path, new, table, "day") == expected
        got = rows(spark.read.schema(table.struct()).parquet(path), "k", "a", "day")
        assert got == [(1, "a", "d1"), (2, "B", "d1"), (3, "c", "d2"), (4, "d", "d3")]
    assert sorted(p.name for p in (tmp_path / "t" / "day=d2").glob("*.parquet")) == untouched
    with pytest.raises(ContractError):
        sync_partitions(path, new, table, "day", delete_within="day")


def test_table_transform(spark, rows, target):
    done = table_transform(target, lambda df: df.withColumn("k", F.col("k") + 10), TABLE, where="n > 1")
    assert rows(done.next_state) == [(12, "two", 2), (13, None, 3)]
