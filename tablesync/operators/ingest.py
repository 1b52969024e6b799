"""From raw game records to table rows: planning, filtering and flattening."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.times import from_epoch_seconds, ntz, to_epoch
from tablesync.operators.guards import any_null, fail_when, required

# The first month the monthly archive has, and the address formats.
FIRST_YEAR = 2005
MONTHLY_URL = "https://api.chess.com/pub"
RANGE_URL = "https://lichess.org/api"

_SIDE = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("result", T.StringType()),
    ]
)
#: A raw game document. Declared, never inferred.
GAME = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("white", _SIDE),
        T.StructField("black", _SIDE),
        T.StructField("time_control", T.StringType()),
        T.StructField("pgn", T.StringType()),
    ]
)
#: A month of games in one document.
ENVELOPE = T.StructType([T.StructField("games", T.ArrayType(GAME))])

REQUIRED = [
    "url",
    "white.username",
    "white.rating",
    "white.result",
    "black.username",
    "black.rating",
]


def month_plan(
    accounts: DataFrame,
    now: datetime,
    *,
    since: str = "latest_ingestion",
    joined: str | None = None,
    base_url: str = MONTHLY_URL,
    username: str = "username",
) -> DataFrame:
    """One row per account and month to request: ``year``, ``month``, ``url``.

    Runs from the month of ``since`` (else of ``joined``, else January of the first
    year) to the month of ``now``, both included. A start after ``now`` asks for
    nothing; a month before the first year fails the job.
    """
    candidates = [F.col(since)] + ([F.col(joined)] if joined else []) + [ntz(f"{FIRST_YEAR}-01-01 00:00:00")]
    # Dates keep the month arithmetic free of any time zone.
    first = F.trunc(F.coalesce(*candidates).cast("date"), "month")
    last = F.trunc(ntz(now).cast("date"), "month")
    months = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    checked = accounts.where(
        fail_when(F.year(first) < FIRST_YEAR, F.lit(f"months before {FIRST_YEAR} cannot be requested"))
    )
    # Each account becomes hundreds of rows: spread the accounts over all cores first.
    spread = checked.repartition(accounts.sparkSession.sparkContext.defaultParallelism, F.col(username))
    planned = spread.select(*accounts.columns, F.explode(months).alias("_month"))
    url = F.concat(
        F.lit(f"{base_url}/player/"),
        F.col(username),
        F.lit("/games/"),
        F.replace(F.substring(F.col("_month").cast("string"), 1, 7), F.lit("-"), F.lit("/")),
    )
    return planned.select(
        *accounts.columns,
        F.year("_month").cast("bigint").alias("year"),
        F.month("_month").cast("bigint").alias("month"),
        url.alias("url"),
    )


def range_plan(
    accounts: DataFrame,
    now: datetime,
    *,
    since: str = "latest_ingestion",
    base_url: str = RANGE_URL,
    username: str = "username",
) -> DataFrame:
    """One row per account of the site that takes a time range: ``url``, ``since_ms`` (NULL
    for all games) and ``until_ms``."""
    return accounts.select(
        *accounts.columns,
        F.concat(F.lit(f"{base_url}/games/user/"), F.col(username)).alias("url"),
        to_epoch(F.col(since), "ms").alias("since_ms"),
        to_epoch(ntz(now), "ms").alias("until_ms"),
    )


def games_explode(documents: DataFrame, column: str = "document") -> DataFrame:
    """One row per game of ``{"games": [...]}`` text; no games, no rows. Other columns stay."""
    rest = [c for c in documents.columns if c != column]
    parsed = F.from_json(F.col(column), ENVELOPE, {"mode": "FAILFAST"})
    return documents.select(*rest, F.explode(parsed["games"]).alias("game")).select(*rest, "game.*")


def incremental_since(
    records: DataFrame,
    accounts: DataFrame,
    *,
    key: str = "account_id",
    end_time: str = "end_time",
    since: str = "latest_ingestion",
) -> DataFrame:
    """Records at or after their account's high watermark.

    ``end_time`` is Unix seconds; a missing one counts as 0, and a missing
    watermark keeps all. ``accounts`` holds each key once. It is broadcast when
    Catalyst finds it small enough; else AQE cuts the accounts with most records.
    """
    state = accounts.select(F.col(key).alias("_key"), to_epoch(F.col(since), "s").alias("_since"))
    joined = records.join(state, records[key] == state["_key"], "left")
    kept = F.coalesce(F.col(end_time), F.lit(0)) >= F.coalesce(F.col("_since"), F.lit(0))
    return joined.where(kept).select(*records.columns)


def game_flatten(
    games: DataFrame, *, source_file: str | None = None, strict: bool = True, extra: Sequence[str] = ()
) -> DataFrame:
    """Raw games to rows of the games table.

    The id, both names and ratings and the result must be there: ``strict`` fails
    the job when one is missing, else such records drop out (``game_rejects``
    returns them). Time, time control and moves may be missing. ``extra`` columns
    are carried along.
    """
    missing = any_null(REQUIRED)
    label = F.concat(F.lit("incomplete game record: "), F.coalesce(F.col("url"), F.lit("without url")))
    kept = games.where(fail_when(missing, label) if strict else ~missing)
    game_id = required(F.col("url"), label) if strict else F.col("url")
    return kept.select(
        game_id.alias("external_game_id"),
        from_epoch_seconds(F.col("end_time")).alias("played_at"),
        F.col("white.username").alias("white_username"),
        F.col("black.username").alias("black_username"),
        F.col("white.rating").alias("white_rating"),
        F.col("black.rating").alias("black_rating"),
        F.col("white.result").alias("result"),
        F.col("time_control"),
        F.col("pgn"),
        (F.col(source_file) if source_file else F.lit(None).cast("string")).alias("source_file"),
        *extra,
    )


def game_rejects(games: DataFrame) -> DataFrame:
    """Records ``game_flatten(strict=False)`` leaves out."""
    return games.where(any_null(REQUIRED))


def advanced_accounts(records: DataFrame, run_started_at: datetime, key: str = "account_id") -> DataFrame:
    """The accounts that had records, with the run's start as their new watermark."""
    return records.select(key).distinct().withColumn("latest_ingestion", ntz(run_started_at))


__all__ = [
    "ENVELOPE",
    "GAME",
    "advanced_accounts",
    "game_flatten",
    "game_rejects",
    "games_explode",
    "incremental_since",
    "month_plan",
    "range_plan",
]
