"""Inputs derived from the given tables.

One SELECT per fixture, run unchanged by DuckDB and, with zone-less timestamp
literals, by Spark. ``{name}`` refers to a given table or another fixture.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NOW = datetime(2024, 1, 31)
DUE_NOW = datetime(2024, 1, 15)
LOCK_TIMEOUT = timedelta(hours=72)
LOG_KEEP = timedelta(days=7)

FIXTURES: dict[str, str] = {
    "fx_target": """
        SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 3 <> 0""",
    "fx_source": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'U' END AS o_orderstatus
        FROM {orders} WHERE o_orderkey % 2 = 0""",
    "fx_source_full": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'U' END AS o_orderstatus,
               -o_totalprice AS o_totalprice
        FROM {orders} WHERE o_orderkey % 2 = 0""",
    "fx_bridge": """
        SELECT o_custkey AS user_id, o_orderkey AS account_id FROM {orders}""",
    "fx_accounts": """
        SELECT o_orderkey AS account_id, 'user_' || CAST(o_custkey AS STRING) AS username,
               CASE WHEN o_orderkey % 2 = 0 THEN 'Chess.com' ELSE 'Lichess' END AS platform,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS latest_ingestion
        FROM {orders} WHERE o_orderstatus <> 'F'
        UNION ALL
        SELECT o_orderkey + 1000000, 'orphan', 'Lichess', NULL FROM {orders} WHERE o_orderkey % 100 = 0""",
    "fx_account_state": """
        SELECT user_id, MAX(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' AND user_id % 10 <> 0 THEN ts END)
               AS latest_ingestion
        FROM {events} GROUP BY user_id""",
    "fx_new_records": """
        SELECT DISTINCT user_id, TIMESTAMP '2024-01-31 00:00:00' AS run_started_at
        FROM {events} WHERE user_id % 4 <> 0""",
    "fx_games": """
        SELECT event_id, user_id, 'https://example.org/game/' || CAST(event_id % 9000 AS STRING) AS url,
               CASE WHEN event_id % 50 = 0 THEN NULL
                    ELSE CAST(1704067200 + event_id * 259 AS BIGINT) END AS end_time,
               'u' || CAST(user_id AS STRING) AS white_username,
               'u' || CAST((user_id + 1) % 150 AS STRING) AS black_username,
               CAST(1000 + event_id % 800 AS INT) AS white_rating,
               CAST(1000 + event_id % 700 AS INT) AS black_rating,
               CASE WHEN event_id % 3 = 0 THEN 'win' WHEN event_id % 3 = 1 THEN 'resigned' ELSE 'agreed' END
                    AS white_result,
               '600' AS time_control, CASE WHEN event_id % 20 = 0 THEN NULL ELSE '1. e4 e5' END AS pgn
        FROM {events}""",
    "fx_ragged": """
        SELECT event_id, CASE
            WHEN event_id % 13 = 0 THEN chr(123) || '"id": broken'
            WHEN event_id % 17 = 0 THEN '[1, 2]'
            ELSE chr(123) || '"id":' || CAST(event_id AS STRING) || ',"kind":"' || event_type || '"'
                 || CASE WHEN event_id % 2 = 0 THEN ',"user":' || CAST(user_id AS STRING) ELSE '' END
                 || CASE WHEN event_id % 3 = 0 THEN ',"tags":["a",' || '"b"]' ELSE '' END
                 || CASE WHEN event_id % 5 = 0 THEN ',"deep":' || chr(123) || '"on":true' || chr(125) ELSE '' END
                 || CASE WHEN event_id % 7 = 0 THEN ',"note":null' ELSE '' END || chr(125) END AS record
        FROM {events}""",
    "fx_steps": """
        SELECT CAST(user_id AS STRING) || '_' || CAST(CAST(ts AS DATE) AS STRING) AS run_id, event_id, user_id,
               'step_' || CAST(event_id AS STRING) AS name, event_id % 3 = 0 AS critical,
               CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result,
               ts AS started_at, ts + INTERVAL '5' SECOND AS finished_at,
               CASE WHEN event_type = 'error' THEN 'boom ' || CAST(event_id AS STRING) END AS error_message
        FROM {events}""",
    "fx_runs": """
        SELECT run_id, 'ingest' AS name, CASE WHEN MAX(user_id) % 7 = 0 THEN NULL ELSE MAX(user_id) END AS user_id,
               MIN(started_at) AS started_at,
               CASE WHEN MIN(event_id % 10) = 0 THEN TIMESTAMP '1970-01-01 00:00:00'
                    ELSE MAX(finished_at) END AS finished_at
        FROM {fx_steps} GROUP BY run_id""",
    "fx_logs": """
        SELECT event_id AS log_id, ts,
               CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARNING'
                    ELSE 'INFO' END AS level,
               'user_' || CAST(user_id AS STRING) AS logger, 'event ' || event_type AS msg,
               CASE WHEN event_type = 'error' THEN 'ValueError' END AS exc_type
        FROM {events}""",
    "fx_users": """
        SELECT c_custkey AS user_id, c_name AS sub, 'google' AS provider,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Premium' END AS tier,
               CASE WHEN c_custkey % 3 = 0 THEN '03:00:00' WHEN c_custkey % 3 = 1 THEN '12:30:00'
                    ELSE '23:15:00' END AS cron_time,
               CASE WHEN c_custkey % 5 = 0 THEN 'America/New_York' WHEN c_custkey % 5 = 1 THEN 'Asia/Tokyo'
                    WHEN c_custkey % 5 = 2 THEN 'Mars/Olympus' ELSE 'Europe/Amsterdam' END AS timezone
        FROM {customer}""",
    # First order of each customer, moved to years that can be requested; some never ingested.
    "fx_since": """
        SELECT o_custkey AS account_id, 'user_' || CAST(o_custkey AS STRING) AS username,
               CASE WHEN o_custkey % 50 = 0 THEN NULL
                    ELSE MIN(o_orderdate) + INTERVAL '10' YEAR END AS latest_ingestion
        FROM {orders} GROUP BY o_custkey""",
    # Runs as the ledger stores them, with a placeholder result while active.
    "fx_ledger": """
        SELECT run_id, name, CAST(user_id AS STRING) AS user_id,
               CASE WHEN finished_at = TIMESTAMP '1970-01-01 00:00:00' THEN 'in_progress' ELSE 'success' END
                    AS result,
               started_at, finished_at
        FROM {fx_runs}""",
}


def _names(sql: str) -> list[str]:
    return sorted({part.split("}")[0] for part in sql.split("{")[1:]})


_SCHEMAS: dict[str, StructType] = {}


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table. Its footer is read once, not once per reference."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a fixture as a DataFrame."""
    if name not in FIXTURES:
        return given(spark, sf_dir, name)
    sql = FIXTURES[name]
    inputs = {n: fixture(spark, sf_dir, n) for n in _names(sql)}
    return spark.sql(sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), **inputs)


def duck(sql: str) -> str:
    """SQL for DuckDB, with the fixtures it names put in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name in FIXTURES:
                visit(FIXTURES[name])
                if name not in needed:
                    needed.append(name)

    def plain(text: str) -> str:
        return text.format(**{n: n for n in _names(text)})

    visit(sql)
    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    ctes = ",\n".join(f"{n} AS ({plain(FIXTURES[n])})" for n in needed)
    return (f"WITH {ctes}\n" if ctes else "") + plain(sql)
