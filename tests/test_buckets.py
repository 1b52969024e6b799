"""Merges into tables laid out by their key."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from tablesync import ColumnContract as C
from tablesync import ContractError, TableContract
from tablesync.operators import merge
from tablesync.plans import bucket_count, bucketed_outcome, merge_bucketed, write_bucketed

STATE = TableContract("s", "state", (C("k", "bigint", nullable=False), C("part", "text", nullable=False), C("v", "double")), ("k", "part"))


@pytest.fixture
def held(spark, tmp_path):
    name = f"held_{uuid.uuid4().hex}"
    rows = spark.range(3000).select(F.col("id").alias("k"), F.lit("p").alias("part"), F.lit(1.0).alias("v"))
    write_bucketed(rows, name, STATE, 6, str(tmp_path / "held"))
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.fixture
def source(spark, tmp_path):
    rows = spark.range(2000, 5000, 2).select(F.col("id").alias("k"), F.lit("p").alias("part"), F.lit(2.0).alias("v"))
    rows.write.parquet(str(tmp_path / "source"))
    return spark.read.parquet(str(tmp_path / "source"))


def exchanges_above(plan: str, scan: str) -> list[str]:
    """Exchanges between the root of a plan and a scan: lines on the way up are indented less."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if scan in line)
    depth = lambda line: len(re.match(r"[\s:+*()\d-]*", line)[0])
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            if "Exchange" in line:
                found.append(line)
    return found


@pytest.mark.parametrize("options", [{}, {"when_not_matched_by_source": "delete"}, {"when_not_matched_by_target": "ignore"}, {"when_matched": "delete"}])
def test_equal_to_merge_without_moving_the_target(spark, rows, held, source, options):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = bucketed_outcome(spark, held, source, STATE, **options)
        wanted = merge(spark.table(held), source, STATE, **options)
        assert rows(done.next_state) == rows(wanted.next_state)
        plan = done.tagged._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and not exchanges_above(plan, "Bucketed: true")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_next_table_is_laid_out_alike(spark, rows, held, source, tmp_path):
    name = f"{held}_next"
    counts = merge_bucketed(spark, held, source, STATE, name, str(tmp_path / "next"))
    try:
        assert (counts["rows_inserted"], counts["rows_updated"], counts["rows_deleted"]) == (1000, 500, 0)
        assert bucket_count(spark, name, STATE) == 6
        assert len(list((tmp_path / "next").glob("*.parquet"))) == 6
        assert rows(spark.table(name)) == rows(merge(spark.table(held), source, STATE).next_state)
        again = merge_bucketed(spark, name, source, STATE, f"{name}2", str(tmp_path / "next2"))
        assert again["rows_updated"] == 1500
        spark.sql(f"DROP TABLE {name}2")
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_other_layouts_are_refused(spark, held, source, tmp_path):
    other = f"other_{uuid.uuid4().hex}"
    source.write.option("path", str(tmp_path / "other")).saveAsTable(other)
    with pytest.raises(ContractError, match="not bucketed"):
        bucketed_outcome(spark, other, source, STATE)
    with pytest.raises(ContractError, match="primary key"):
        bucketed_outcome(spark, held, source, STATE, keys=["part"])
    spark.sql(f"DROP TABLE {other}")
