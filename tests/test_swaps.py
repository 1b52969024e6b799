"""Partition-wise deletes and full syncs, and tables mended after a crash at any step."""

import pytest

from tablesync import ColumnContract as C
from tablesync import TableContract, swaps
from tablesync.plans import sync_partitions

DAYS = TableContract("s", "days", (C("id", "integer", nullable=False), C("day", "text"), C("v", "text")), primary_key=("id",))
SCHEMA = "id int, day string, v string"
HELD = [(1, None, "a"), (2, "x/y z", "b"), (3, "y", "c"), (4, "y", "d"), (5, "w", "e")]


@pytest.fixture
def table(spark, tmp_path):
    path = tmp_path / "t"
    spark.createDataFrame(HELD, SCHEMA).write.partitionBy("day").parquet(str(path))
    return path


def state(spark, path):
    return sorted(tuple(r) for r in spark.read.schema(DAYS.struct()).parquet(str(path)).select("id", "day", "v").collect())


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir() and p.name.startswith("day="))


def by_id(rows):
    return sorted(rows, key=lambda r: r[0])


def test_full_sync_drops_what_the_source_lacks(spark, table):
    new = [(1, None, "A"), (4, "y", "D"), (9, "new", "n")]
    counts = sync_partitions(str(table), spark.createDataFrame(new, SCHEMA), DAYS, "day", when_not_matched_by_source="delete")
    assert state(spark, table) == by_id(new)
    assert (counts["rows_inserted"], counts["rows_updated"], counts["rows_deleted"]) == (1, 2, 3)
    assert folders(table) == ["day=__HIVE_DEFAULT_PARTITION__", "day=new", "day=y"]


def test_full_sync_within_the_touched_partitions(spark, table):
    new = [(4, "y", "D"), (9, "x/y z", "n")]
    counts = sync_partitions(
        str(table), spark.createDataFrame(new, SCHEMA), DAYS, "day", when_not_matched_by_source="delete", delete_within="touched"
    )
    assert state(spark, table) == by_id([HELD[0], HELD[4], *new])
    assert (counts["rows_inserted"], counts["rows_updated"], counts["rows_deleted"]) == (1, 1, 2)


def test_emptied_partitions_vanish(spark, table):
    keys = [(1, None, None), (2, "x/y z", None), (3, "y", None)]
    options = {"when_matched": "delete", "when_not_matched_by_target": "ignore"}
    counts = sync_partitions(str(table), spark.createDataFrame(keys, SCHEMA), DAYS, "day", **options)
    assert state(spark, table) == HELD[3:] and folders(table) == ["day=w", "day=y"]
    assert counts["rows_deleted"] == 3


def test_an_empty_source_changes_nothing(spark, table):
    counts = sync_partitions(str(table), spark.createDataFrame([], SCHEMA), DAYS, "day", when_not_matched_by_source="delete")
    assert state(spark, table) == by_id(HELD) and counts["rows_deleted"] == 0


def test_every_partition_can_go(spark, table):
    options = {"when_matched": "delete", "when_not_matched_by_target": "ignore"}
    sync_partitions(str(table), spark.createDataFrame(HELD, SCHEMA), DAYS, "day", **options)
    assert state(spark, table) == [] and folders(table) == []


def test_source_is_read_once_and_other_folders_are_not(spark, table):
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            seen.add(1)
            yield r

    source = spark.createDataFrame(spark.sparkContext.parallelize([(4, "y", "D")], 1).mapPartitions(counted), SCHEMA)
    sync_partitions(str(table), source, DAYS, "day")
    assert seen.value == 1
    kept = spark.read.schema(DAYS.struct()).parquet(str(table)).where("NOT coalesce(day IN ('y'), false)")
    assert "PartitionFilters: [NOT coalesce" in kept._jdf.queryExecution().toString()


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", range(12))
def test_a_crash_at_any_step_is_mended_by_the_next_call(spark, table, monkeypatch, step):
    """Each rename, deletion and written list in turn is the one that the first call does not survive."""
    new = spark.createDataFrame([(1, None, "A"), (4, "y", "D"), (9, "new", "n")], SCHEMA)
    left = [step]

    def crashing(name):
        plain = getattr(swaps.Folder, name)

        def call(self, *args):
            if left[0] == 0:
                raise Crash
            left[0] -= 1
            return plain(self, *args)

        return call

    with monkeypatch.context() as patched:
        for name in ("rename", "delete", "write"):
            patched.setattr(swaps.Folder, name, crashing(name))
        try:
            sync_partitions(str(table), new, DAYS, "day", when_not_matched_by_source="delete")
        except Crash:
            pass
    sync_partitions(str(table), new, DAYS, "day", when_not_matched_by_source="delete")
    assert state(spark, table) == [(1, None, "A"), (4, "y", "D"), (9, "new", "n")]
    assert folders(table) == ["day=__HIVE_DEFAULT_PARTITION__", "day=new", "day=y"]
    assert not [p.name for p in table.iterdir() if p.name.startswith("_aside")] and not list((table / "_swaps").glob("*.json"))
