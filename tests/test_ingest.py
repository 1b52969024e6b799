import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from helpers import fails

from tablesync import stored_table
from tablesync.operators import (
    GAME,
    game_flatten,
    game_rejects,
    games_explode,
    incremental_since,
    month_plan,
    range_plan,
)
from tablesync.plans import ingest_batch
from tablesync.sources import landing_load, landing_write, log_read, log_tail, ndjson_read

NOW = datetime(2024, 3, 10, 2, 30)


def game(url="g1", end_time=1700000000, **changes):
    side = {"username": "ann", "rating": 1500, "result": "win"}
    doc = {"url": url, "end_time": end_time, "white": side, "black": {**side, "username": "bob"}, "time_control": "600"}
    doc.update(changes)
    return {k: v for k, v in doc.items() if v is not None}


def lines(path, *texts):
    path.write_text("\n".join(texts) + "\n")
    return str(path)


def test_ndjson_skips_blank_lines_and_fails_on_a_bad_one(spark, tmp_path):
    good = lines(tmp_path / "a.jsonl", json.dumps(game()), "", json.dumps(game("g2", None)), "")
    assert ndjson_read(spark, good, GAME).count() == 2
    bad = lines(tmp_path / "b.jsonl", json.dumps(game()), '{"url": ')
    with fails("FAILED_READ_FILE"):
        ndjson_read(spark, bad, GAME).collect()
    kept = ndjson_read(spark, bad, GAME, quarantine=True).cache()
    assert kept.where("_corrupt_record IS NOT NULL").first()._corrupt_record == '{"url": '
    assert kept.where("_corrupt_record IS NULL").count() == 1


def test_games_explode(spark, rows):
    documents = [
        ("a", json.dumps({"games": [game("g1"), game("g2")]})),
        ("b", "{}"),
        ("c", '{"games": []}'),
        ("d", '{"games": null}'),
    ]
    df = spark.createDataFrame(documents, "account string, document string")
    assert rows(games_explode(df), "account", "url") == [("a", "g1"), ("a", "g2")]
    with fails("MALFORMED_RECORD"):
        games_explode(spark.createDataFrame([("a", "{")], df.schema)).collect()


def test_flatten(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", json.dumps(game(end_time=None, time_control=None)))
    row = game_flatten(ndjson_read(spark, path, GAME)).first()
    assert (row.external_game_id, row.played_at, row.time_control, row.pgn) == ("g1", None, None, None)
    assert (row.white_username, row.black_username, row.white_rating, row.result) == ("ann", "bob", 1500, "win")
    timed = game_flatten(ndjson_read(spark, lines(tmp_path / "b.jsonl", json.dumps(game())), GAME)).first()
    assert timed.played_at == datetime(2023, 11, 14, 22, 13, 20)


@pytest.mark.parametrize("missing", ["url", "white", "black"])
def test_incomplete_records(spark, tmp_path, missing):
    path = lines(tmp_path / "a.jsonl", json.dumps(game("ok")), json.dumps(game(**{"url": "part", missing: None})))
    raw = ndjson_read(spark, path, GAME)
    with fails("incomplete game record"):
        game_flatten(raw).collect()
    assert [r.external_game_id for r in game_flatten(raw, strict=False).collect()] == ["ok"]
    assert game_rejects(raw).count() == 1


def test_since_is_inclusive_and_null_safe(spark, rows):
    accounts = spark.createDataFrame(
        [("a", datetime(2023, 11, 14, 22, 13, 20, 900000)), ("new", None)],
        "account_id string, latest_ingestion timestamp_ntz",
    )
    records = spark.createDataFrame(
        [
            ("a", 1700000000),  # the watermark, cut to whole seconds
            ("a", 1699999999),
            ("a", None),  # counts as 0
            ("new", None),
            ("new", 1),
            ("unknown", 1),
            (None, 1),
        ],
        "account_id string, end_time bigint",
    )
    assert rows(incremental_since(records, accounts)) == [
        (None, 1),
        ("a", 1700000000),
        ("new", None),
        ("new", 1),
        ("unknown", 1),
    ]


def test_month_plan(spark, rows):
    accounts = spark.createDataFrame(
        [
            ("a", datetime(2023, 12, 31, 23, 59), None),
            ("b", None, datetime(2024, 2, 29)),
            ("future", datetime(2024, 4, 1), None),
        ],
        "username string, latest_ingestion timestamp_ntz, joined timestamp_ntz",
    )
    plan = month_plan(accounts, NOW, joined="joined")
    assert rows(plan, "username", "year", "month") == [
        ("a", 2023, 12),
        ("a", 2024, 1),
        ("a", 2024, 2),
        ("a", 2024, 3),
        ("b", 2024, 2),
        ("b", 2024, 3),
    ]
    assert plan.where("username = 'b'").agg(F.min("url")).first()[0].endswith("/player/b/games/2024/02")
    since_launch = month_plan(accounts.where("username = 'b'").drop("joined"), NOW)
    assert since_launch.count() == 19 * 12 + 3
    early = spark.createDataFrame([("x", datetime(2004, 12, 31))], "username string, latest_ingestion timestamp_ntz")
    with fails("before 2005"):
        month_plan(early, NOW).collect()


def test_range_plan(spark):
    accounts = spark.createDataFrame(
        [("a", datetime(1970, 1, 1, 0, 0, 1, 500000)), ("b", None)], "username string, latest_ingestion timestamp_ntz"
    )
    got = {r.username: (r.url, r.since_ms, r.until_ms) for r in range_plan(accounts, NOW, base_url="x").collect()}
    assert got == {"a": ("x/games/user/a", 1500, 1710037800000), "b": ("x/games/user/b", None, 1710037800000)}


def test_landing_round_trip(spark, rows, tmp_path):
    root = tmp_path / "raw"
    raw = ndjson_read(spark, lines(tmp_path / "a.jsonl", json.dumps(game("g1")), json.dumps(game("g2"))), GAME)
    records = raw.withColumn("account_id", F.lit("acc"))
    landing_write(records.limit(0), str(root), "2024-03-09")
    assert not list(root.rglob("*.json"))
    landing_write(records, str(root), "2024-03-09")
    landing_write(records, str(root), "2024-03-10", partition_by=("account_id", "ingest_date"))
    assert {p.parent.name for p in root.rglob("*.json")} == {"ingest_date=2024-03-09", "ingest_date=2024-03-10"}
    # Files of other layouts are found too; half-written ones are not.
    day = root / "ingested" / "acc" / "2024" / "03" / "11"
    day.mkdir(parents=True)
    (day / "Lichess_1.jsonl").write_text(json.dumps(game("g3")) + "\n")
    (day / "Lichess_2.tmp").write_text('{"url"')
    loaded = landing_load(spark, str(root), GAME)
    assert rows(loaded, "url") == [("g1",), ("g1",), ("g2",), ("g2",), ("g3",)]
    assert loaded.where("url = 'g3'").first().source_file == "Lichess_1.jsonl"
    assert all(r.source_file and r.source_path for r in loaded.collect())


def test_ingest_batch_twice_is_once(spark, rows, tmp_path):
    raw = ndjson_read(
        spark,
        lines(
            tmp_path / "a.jsonl",
            json.dumps(game("g1", 100)),
            json.dumps(game("g1", 90)),
            json.dumps(game("old", 5)),
            json.dumps(game("held", 200)),
        ),
        GAME,
    ).withColumn("account_id", F.lit("a"))
    games, accounts = stored_table("games"), stored_table("accounts")
    held = spark.createDataFrame([("held",)], "external_game_id string")
    for c in games.columns[1:]:
        held = held.withColumn(c.name, c.default_value())
    state = spark.createDataFrame(
        [("a", "ann", "Lichess", datetime(1970, 1, 1, 0, 0, 10)), ("b", "bob", "Lichess", None)], accounts.struct()
    )
    done = ingest_batch(raw, state, held, games, accounts, NOW)
    first = done.games.next_state
    assert rows(first.select("external_game_id", F.col("played_at").cast("string"))) == [
        ("g1", "1970-01-01 00:01:30"),
        ("held", None),
    ]
    assert rows(done.accounts.next_state, "account_id", "latest_ingestion") == [("a", NOW), ("b", None)]
    assert done.rejects.count() == 0
    again = ingest_batch(raw, state, first, games, accounts, NOW)
    assert rows(again.games.next_state) == rows(first)


def test_logs(spark, rows, tmp_path):
    texts = [
        json.dumps({"ts": f"2024-03-10T02:30:0{i}+00:00", "level": "INFO", "logger": "l", "msg": "m", "log_id": str(i)})
        for i in range(5)
    ]
    failed = {"ts": "2024-03-10T03:30:00.5+01:00", "logger": "other", "log_id": "9", "exc_type": "ValueError"}
    logs = log_read(spark, lines(tmp_path / "app.log", *texts, json.dumps(failed)))
    row = logs.where("log_id = '9'").first()
    assert (row.ts, row.exc_type, row.traceback) == (datetime(2024, 3, 10, 2, 30, 0, 500000), "ValueError", None)
    assert [r.log_id for r in log_tail(logs, lines=2, ordered=True).collect()] == ["3", "4", "9"]
