"""Profiles that merge, records whose keys differ, and text times with a zone."""

from datetime import datetime

import pytest
from helpers import fails
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync import ColumnContract as C
from tablesync import TableContract
from tablesync.operators import (
    contract_check,
    found_fields,
    merge_profiles,
    profile_partitions,
    profile_summary,
    profile_update,
    ragged_records,
    ragged_schema,
    schema_diff,
    schema_reconcile,
)

EVENTS = TableContract(
    "s", "events", (C("id", "bigint", nullable=False), C("n", "smallint"), C("at", "timestamp"), C("day", "text")), ("id",)
)
RAW = "id long, n string, at string, day string"


def rows(days, start=0):
    return [
        (start + 100 * d + i, None if i % 7 == 0 else "x" if i % 11 == 0 else str(i - 20), f"2024-01-{d + 1:02} 10:00:{i:02}", None if d == 3 else f"d{d}")
        for d in days
        for i in range(40)
    ]


def facts(profile):
    return sorted(tuple(str(v) for v in r) for r in profile.drop("sketch").collect())


def test_profile_of_all_equals_the_merge_of_parts(spark):
    every = spark.createDataFrame(rows(range(5)), RAW)
    whole = profile_partitions(every, EVENTS, "day")
    parts = [profile_partitions(spark.createDataFrame(rows(d), RAW), EVENTS, "day") for d in ([0, 1], [2, 3], [4])]
    merged = merge_profiles(*parts)
    assert facts(merged) == facts(whole)
    both = [{r["column"]: tuple(r) for r in profile_summary(p, EVENTS).collect()} for p in (whole, merged)]
    assert both[0] == both[1]
    n = both[0]["n"]
    given = [r[1] for r in rows(range(5))]
    kept = [int(v) for v in given if v not in (None, "x")]
    assert n[1:6] == (200, given.count(None), given.count("x"), str(min(kept)), str(max(kept))) and abs(n[6] - len(set(kept))) <= 2
    assert both[0]["at"][4:6] == ("2024-01-01 10:00:00", "2024-01-05 10:00:39")


def test_a_partition_read_anew_replaces_its_old_profile(spark):
    old = profile_partitions(spark.createDataFrame(rows([0, 1]), RAW), EVENTS, "day")
    new = profile_partitions(spark.createDataFrame(rows([1, 2], 5000), RAW), EVENTS, "day")
    merged = merge_profiles(old, new).where("column = 'id'")
    assert sorted((r["partition"], r["low"]) for r in merged.collect()) == [("d0", "0"), ("d1", "5100"), ("d2", "5200")]


def test_an_update_reads_new_partitions_only(spark, tmp_path):
    path, schema = str(tmp_path / "t"), T._parse_datatype_string(RAW)
    spark.createDataFrame(rows([0, 3]), RAW).write.partitionBy("day").parquet(path)
    first = profile_update(spark, path, None, EVENTS, "day", schema)
    first.write.parquet(str(tmp_path / "p1"))
    stored = spark.read.parquet(str(tmp_path / "p1"))
    spark.createDataFrame(rows([1, 2]), RAW).write.mode("append").partitionBy("day").parquet(path)
    # What is in old partitions is not looked at again.
    for old in (tmp_path / "t").glob("day=[d_][0H]*/*.parquet"):
        old.write_bytes(b"broken")
    later = profile_update(spark, path, stored, EVENTS, "day", schema)
    assert facts(later) == facts(profile_partitions(spark.createDataFrame(rows(range(4)), RAW), EVENTS, "day"))


def test_empty_profile(spark):
    assert profile_partitions(spark.createDataFrame([], RAW), EVENTS, "day").collect() == []


KNOWN = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("at", T.StructType([T.StructField("x", T.DoubleType())]))])


def test_ragged_records(spark):
    texts = [
        '{"id": 1, "name": "a", "z": [1, {"k": null}], "b\\"q": "t"}',
        '{"id": "no number", "at": {"x": 1.5}}',
        '{"name": null, "id": 7}',
        "{}",
        "[1]",
        "3",
        "{broken",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r for r in ragged_records(df, "t", KNOWN).collect()}
    assert (got[0]["id"], got[0]["name"], got[0]["rest"]) == (1, "a", '{"b\\"q":"t","z":[1,{"k":null}]}')
    assert (got[1]["id"], got[1]["at"]["x"], got[1]["rest"]) == (None, 1.5, None)
    assert (got[2]["id"], got[2]["name"]) == (7, None)
    assert [got[i]["bad_json"] for i in range(9)] == [None, None, None, None, "[1]", "3", "{broken", "", None]
    # A filter on what came out of a record does not change it.
    assert [r["k"] for r in ragged_records(df, "t", KNOWN).where("id > 1").collect()] == [2]


def test_fields_and_schema_found(spark):
    texts = ['{"a": 1, "b": "x"}', '{"a": 2.5}', '{"c": {"d": true}}', "broken"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert sorted((r["field"], r["n"]) for r in found_fields(df, "t").collect()) == [("a", 1), ("a", 1), ("b", 1), ("c", 1)]
    found = ragged_schema(df, "t").first()
    assert found["n_bad"] == 1 and found["n_records"] == 4 and all(x in found["schema"] for x in ("a: ", "b: STRING", "d: BOOLEAN"))


TIMED = TableContract("s", "timed", (C("id", "bigint", nullable=False), C("at", "timestamp")), ("id",))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-01 05:00:00+02:00", datetime(2024, 1, 1, 3)),
        ("2024-01-01 05:00:00 Asia/Tokyo", datetime(2023, 12, 31, 20)),
        ("2024-01-01 05:00:00Z", datetime(2024, 1, 1, 5)),
        ("2024-01-01 05:00:00", datetime(2024, 1, 1, 5)),
        ("2024-01-01", datetime(2024, 1, 1)),
        (None, None),
    ],
)
def test_zoned_text_is_stored_in_utc(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id long, at string")
    assert schema_reconcile(df, TIMED).first()["at"] == want
    assert [r["n_bad"] for r in schema_diff(df, TIMED).where("kind = 'type'").collect()] == [0]
    assert [r["n_bad"] for r in contract_check(df, TIMED).where("rule = 'type'").collect()] == [0]


@pytest.mark.parametrize("text", ["2024-01-01 05:00:00 Mars/Base", "soon", "2024-13-01"])
def test_text_that_is_no_time_fails(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, at string")
    with fails("does not cast"):
        schema_reconcile(df, TIMED).collect()
    assert schema_diff(df, TIMED).where("kind = 'type'").first()["n_bad"] == 1
