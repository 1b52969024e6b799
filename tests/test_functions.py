import hashlib
from datetime import UTC, date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tablesync import ContractError, PredicateError
from tablesync import functions as fn


def one(df):
    return df.first()[0]


def ntz_frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))


def test_null_safe_predicates(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, None)], "a int, b string")
    assert rows(df.where(fn.key_predicate(["a", "b"], [2, None]))) == [(2, None)]
    assert rows(df.where(fn.null_safe_equal("a", None))) == [(None, None)]
    with pytest.raises(ValueError):
        fn.key_predicate(["a", "b"], [1])
    with pytest.raises(PredicateError):
        fn.key_predicate([], [])


def test_text_predicates_read_double_quotes_as_names(spark, rows):
    df = spark.createDataFrame([("a", 'say "b"'), ("c", "d")], "u string, v string")
    assert rows(df.where(fn.as_predicate("\"u\" = 'a' AND v = 'say \"b\"'", "test"))) == [("a", 'say "b"')]
    for blank in (None, "", "  "):
        with pytest.raises(PredicateError):
            fn.as_predicate(blank, "test")


def test_surrogate_key_follows_text_rules(spark):
    row = ("a,b", None, True, 7, datetime(2024, 1, 2, 3, 4, 5, 600000), datetime(2024, 1, 2), date(2024, 1, 2))
    df = spark.createDataFrame([row], "s string, n string, b boolean, i int, t timestamp_ntz, u timestamp_ntz, d date")
    expected = hashlib.sha256(",".join(str(v) for v in row).encode()).hexdigest()
    assert one(df.select(fn.surrogate_key(df, list("snbitud")))) == expected
    with pytest.raises(ContractError):
        fn.surrogate_key(df, ["s", "absent"])
    with pytest.raises(ContractError):
        fn.surrogate_key(df.withColumn("f", F.lit(1.5)), ["f"])


def test_surrogate_key_separator_is_not_escaped(spark):
    df = spark.createDataFrame([("a,b", "c"), ("a", "b,c")], "x string, y string")
    assert df.select(fn.surrogate_key(df, ["x", "y"])).distinct().count() == 1


@pytest.mark.parametrize("text", ["2024-03-10 02:30:00.123456", "2024-11-03 01:30:00", "1969-12-31 23:59:58.5"])
def test_epoch_ignores_the_session_zone(spark, text):
    moment = datetime.fromisoformat(text).replace(tzinfo=UTC)
    micros = (moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    df = ntz_frame(spark, text)
    got = df.select(fn.epoch_micros(F.col("t")), fn.to_epoch(F.col("t"), "s"), fn.to_epoch(F.col("t"), "ms")).first()
    assert tuple(got) == (micros, int(micros / 1e6), int(micros / 1e3))
    with pytest.raises(ValueError):
        fn.to_epoch(F.col("t"), "us")


def test_epoch_seconds_round_trip(spark):
    df = spark.createDataFrame([(0,), (1710037800,), (None,)], "s bigint")
    got = [r[0] for r in df.select(fn.from_epoch_seconds(F.col("s"))).collect()]
    assert got == [datetime(1970, 1, 1), datetime(2024, 3, 10, 2, 30), None]


@pytest.mark.parametrize(
    ("text", "utc"),
    [
        ("2024-03-10 02:30:00", datetime(2024, 3, 10, 2, 30)),
        ("2024-03-10T02:30:00.25Z", datetime(2024, 3, 10, 2, 30, 0, 250000)),
        ("2024-11-03T01:30:00-04:00", datetime(2024, 11, 3, 5, 30)),
        ("2024-11-03T01:30:00-05:00", datetime(2024, 11, 3, 6, 30)),
        ("2024-07-01 09:00:00 Asia/Tokyo", datetime(2024, 7, 1)),
        ("2024-07-01 09:00:00+09", datetime(2024, 7, 1)),
        ("2024-07-01", datetime(2024, 7, 1)),
        (None, None),
    ],
)
def test_text_to_utc(spark, text, utc):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(fn.text_to_utc(F.col("t")))) == utc


def test_zoned_and_aware_values(spark):
    df = ntz_frame(spark, "2024-07-01 03:00:00")
    assert one(df.select(fn.zoned_to_utc(F.col("t"), "Europe/Amsterdam"))) == datetime(2024, 7, 1, 1)
    aware = datetime(2024, 7, 1, 9, tzinfo=timezone(timedelta(hours=9)))
    assert one(df.select(fn.ntz(aware))) == datetime(2024, 7, 1)


def test_paths_and_durations(spark):
    df = ntz_frame(spark, "2024-03-10 02:05:09.5")
    got = df.select(fn.day_path(F.col("t")), fn.day_minute_path(F.col("t"))).first()
    assert tuple(got) == ("2024/03/10", "2024/03/10/0205")
    span = df.select(fn.duration_seconds(F.col("t"), fn.ntz("2024-03-10 03:05:10")))
    assert one(span) == 3600.5
    assert one(df.select(fn.duration_seconds(F.col("t"), fn.ntz(fn.EPOCH)))) is None


def test_account_text(spark, rows):
    df = spark.createDataFrame([("  ann ",), ("   ",), (None,)], "u string")
    assert rows(df.select(fn.clean_username(F.col("u")))) == [(None,), (None,), ("ann",)]
    shown = df.limit(1).select(fn.account_label(F.lit("Lichess"), F.lit("ann")), fn.ingestion_text(F.lit(None)))
    assert tuple(shown.first()) == ("Lichess - ann", "Never")


def test_enum_valid(spark, rows):
    df = spark.createDataFrame([("Free",), ("free",), (None,)], "tier string")
    assert rows(df.select("tier", fn.enum_valid("tier", ["Free", "Premium"]))) == [
        (None, False),
        ("Free", True),
        ("free", False),
    ]
