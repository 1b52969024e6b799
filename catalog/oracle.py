"""The registered queries in SQL, for DuckDB on the same tables."""

from __future__ import annotations

from catalog.fixtures import duck

_PK = "l_orderkey, l_linenumber"
_REST = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_FIRST_LINE = f"row_number() OVER (PARTITION BY {_PK} ORDER BY {_REST})"

_UPSERT = """
    SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
           CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
           t.o_totalprice
    FROM {fx_target} t FULL JOIN {fx_source} s ON t.o_orderkey = s.o_orderkey"""

_FLAT = """
    SELECT url AS external_game_id, make_timestamp(end_time * 1000000) AS played_at, white_username, black_username,
           white_rating, black_rating, white_result AS result, time_control, pgn
    FROM {fx_games}"""

_LOG = "log_id, ts, level, logger, msg, exc_type"

_NUMBERED = """
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at, event_id) - 1 AS step_order
    FROM {fx_steps}"""

_OUTCOME = """
    SELECT run_id, CASE WHEN bool_or(result = 'failure' AND critical) THEN 'failure'
                        WHEN bool_or(result = 'failure') THEN 'partial' ELSE 'success' END AS result
    FROM {fx_steps} GROUP BY run_id"""

_SINCE = """
    SELECT g.*, epoch_us(a.latest_ingestion) // 1000000 AS since
    FROM {fx_games} g LEFT JOIN {fx_account_state} a ON g.user_id = a.user_id
    WHERE coalesce(g.end_time, 0) >= coalesce(epoch_us(a.latest_ingestion) // 1000000, 0)"""

_DIFF = """
    SELECT 'o_source' AS "column", 'missing' AS kind, 'string' AS expected, NULL AS actual, 0 AS n_bad
    UNION ALL SELECT 'o_orderdate', 'extra', NULL, 'timestamp_ntz', 0
    UNION ALL SELECT 'o_totalprice', 'default', '0.5', NULL, 0
    UNION ALL SELECT 'o_custkey', 'type', 'string', 'bigint', 0
    UNION ALL SELECT 'o_orderpriority', 'type', 'int', 'string',
                     count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS INT) IS NULL)
              FROM {orders}
    UNION ALL SELECT 'o_orderstatus', 'nullable', 'not null', 'null', count(*) FILTER (WHERE o_orderstatus = 'P')
              FROM {orders}"""

_EVENT_DAYS = """
    SELECT *, CAST(substr(day, 9, 2) AS INT) AS dom
    FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day, value FROM {events})"""

_SQL: dict[str, str] = {
    # merges
    "merge_upsert": _UPSERT,
    "merge_upsert_shuffled": _UPSERT,
    "merge_bucketed": _UPSERT,
    "merge_upsert_in_place": _UPSERT,
    "merge_upsert_split_shuffled": _UPSERT,
    "merge_full_sync": """
        SELECT s.o_orderkey, s.o_orderstatus, t.o_totalprice
        FROM {fx_source} s LEFT JOIN {fx_target} t ON t.o_orderkey = s.o_orderkey""",
    "merge_insert_new": """
        SELECT * FROM {fx_target}
        UNION ALL
        SELECT o_orderkey, o_orderstatus, NULL FROM {fx_source} s
        WHERE NOT EXISTS (SELECT 1 FROM {fx_target} t WHERE t.o_orderkey = s.o_orderkey)""",
    "merge_update_only": """
        SELECT t.o_orderkey,
               CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
               t.o_totalprice
        FROM {fx_target} t LEFT JOIN {fx_source} s ON t.o_orderkey = s.o_orderkey""",
    "merge_delete_matched": """
        SELECT t.* FROM {fx_target} t
        WHERE NOT EXISTS (SELECT 1 FROM {fx_source} s WHERE t.o_orderkey = s.o_orderkey)
        UNION ALL
        SELECT o_orderkey, o_orderstatus, NULL FROM {fx_source} s
        WHERE NOT EXISTS (SELECT 1 FROM {fx_target} t WHERE t.o_orderkey = s.o_orderkey)""",
    "merge_condition": """
        SELECT t.o_orderkey,
               CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
               t.o_totalprice
        FROM {fx_target} t LEFT JOIN {fx_source} s
          ON t.o_orderkey = s.o_orderkey AND t.o_totalprice > 100000 AND t.o_orderstatus <> 'F'""",
    "merge_condition_insert": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE (o_orderkey % 4 = 1) IS NOT TRUE
        UNION ALL
        SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} s WHERE o_orderkey % 4 = 1 AND NOT EXISTS (
            SELECT 1 FROM {orders} t
            WHERE (t.o_orderkey % 4 = 1) IS NOT TRUE AND t.o_custkey = s.o_custkey AND s.o_totalprice > t.o_totalprice)""",
    "merge_condition_insert_all": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE (o_orderkey % 2 = 1) IS NOT TRUE
        UNION ALL
        SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} s WHERE o_orderkey % 2 = 1 AND NOT EXISTS (
            SELECT 1 FROM {orders} t
            WHERE (t.o_orderkey % 2 = 1) IS NOT TRUE AND t.o_custkey = s.o_custkey AND s.o_totalprice > t.o_totalprice)""",
    "merge_partial": """
        SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
               CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
               CASE WHEN t.o_orderkey IS NULL THEN 0.5 ELSE t.o_totalprice END AS o_totalprice
        FROM {fx_target} t FULL JOIN {fx_source_full} s ON t.o_orderkey = s.o_orderkey""",
    "merge_metrics": """
        SELECT 'merge' AS strategy,
               count(*) FILTER (WHERE t.o_orderkey IS NULL) AS rows_inserted,
               count(*) FILTER (WHERE t.o_orderkey IS NOT NULL AND s.o_orderkey IS NOT NULL) AS rows_updated,
               count(*) FILTER (WHERE s.o_orderkey IS NULL) AS rows_deleted
        FROM {fx_target} t FULL JOIN {fx_source} s ON t.o_orderkey = s.o_orderkey""",
    # other writes
    "append_strict": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders}",
    "insert_ignore": f"""
        SELECT {_PK}, {_REST} FROM {{lineitem}} WHERE l_orderkey % 4 = 0
        UNION ALL
        SELECT {_PK}, {_REST} FROM (SELECT *, {_FIRST_LINE} AS n FROM {{lineitem}}) b
        WHERE n = 1 AND NOT EXISTS (
            SELECT 1 FROM {{lineitem}} t WHERE t.l_orderkey % 4 = 0
              AND t.l_orderkey = b.l_orderkey AND t.l_linenumber = b.l_linenumber)""",
    "dedupe_by_key": f"SELECT * EXCLUDE (n) FROM (SELECT *, {_FIRST_LINE} AS n FROM {{lineitem}}) WHERE n = 1",
    "overwrite_table": "SELECT o_orderkey, o_orderstatus, 0.5::DOUBLE AS o_totalprice FROM {fx_source}",
    "update_where": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               CASE WHEN nullif(o_orderstatus, 'P') = 'F' THEN NULL ELSE o_orderdate END AS o_orderdate,
               CASE WHEN nullif(o_orderstatus, 'P') = 'F' THEN 'HELD' ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    "delete_where": "SELECT * FROM {orders} WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)",
    "write_counts": """
        SELECT 'update_where' AS strategy, 0::BIGINT AS rows_inserted, count(*) AS rows_updated,
               0::BIGINT AS rows_deleted
        FROM {orders} WHERE o_orderstatus = 'F'
        UNION ALL
        SELECT 'delete_where', 0, 0, count(*) FROM {orders} WHERE o_orderstatus = 'F'""",
    "watermark_advance": """
        SELECT a.user_id, CASE WHEN n.user_id IS NOT NULL THEN n.run_started_at ELSE a.latest_ingestion END
               AS latest_ingestion
        FROM {fx_account_state} a LEFT JOIN {fx_new_records} n ON a.user_id = n.user_id""",
    # reads
    "table_read": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F' AND o_custkey > 10",
    "order_limit": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "row_count": "SELECT count(*) AS n_rows FROM {orders} WHERE o_orderstatus = 'F'",
    "row_exists": "SELECT EXISTS (SELECT 1 FROM {events} WHERE event_type = 'error') AS found",
    "keys_exist": """
        SELECT c_custkey AS user_id,
               EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS found
        FROM {customer}""",
    "keyed_lookup": """
        SELECT c_custkey AS user_id, count(account_id) AS n_found,
               CASE count(account_id) WHEN 1 THEN 'ok' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status,
               CASE WHEN count(account_id) = 1 THEN min(account_id) END AS account_id
        FROM {customer} LEFT JOIN {fx_bridge} ON user_id = c_custkey GROUP BY c_custkey""",
    "concat_batches": """
        SELECT o_orderkey, o_totalprice, NULL AS o_orderpriority FROM {orders} WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM {orders}
        UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM {orders} WHERE o_orderstatus = 'F'""",
    # links
    "accounts_for_user": """
        SELECT user_id, a.* FROM {fx_bridge} b JOIN {fx_accounts} a ON a.account_id = b.account_id""",
    "stale_links": """
        SELECT * FROM {fx_bridge} b
        WHERE NOT EXISTS (SELECT 1 FROM {fx_accounts} a WHERE a.account_id = b.account_id)""",
    "unlink_cascade": """
        SELECT 'link' AS kind, user_id, account_id FROM {fx_bridge}
        WHERE user_id NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)
        UNION ALL
        SELECT 'user', c_custkey, NULL FROM {customer} WHERE NOT c_acctbal < 0""",
    "orphan_accounts": """
        SELECT * FROM {fx_accounts} a
        WHERE NOT EXISTS (SELECT 1 FROM {fx_bridge} b WHERE a.account_id = b.account_id)""",
    "link_add": """
        SELECT DISTINCT user_id, account_id, account_id % 2 <> 0 AS is_new FROM {fx_bridge}""",
    "link_add_accounts": """
        SELECT * FROM {fx_accounts}
        UNION ALL
        SELECT o_orderkey, 'new_' || CAST(o_custkey AS STRING), 'Lichess', NULL FROM {orders}
        WHERE NOT EXISTS (SELECT 1 FROM {fx_accounts} a WHERE a.account_id = o_orderkey)""",
    "link_remove": "SELECT * FROM {fx_bridge} WHERE account_id % 4 <> 0",
    "account_label": """
        SELECT account_id, username, platform || ' - ' || username AS label,
               coalesce(CAST(latest_ingestion AS STRING), 'Never') AS latest_ingestion
        FROM {fx_accounts} WHERE account_id % 7 <> 0""",
    # scalars
    "null_safe_filter": "SELECT * FROM {fx_users} WHERE tier IS NOT DISTINCT FROM NULL AND timezone = 'Asia/Tokyo'",
    "surrogate_key": """
        SELECT c_custkey, sha256(CAST(c_custkey AS STRING) || ',' ||
               CASE c_mktsegment WHEN 'BUILDING' THEN 'None' ELSE c_mktsegment END || ',' ||
               CASE WHEN c_nationkey % 2 = 0 THEN 'True' ELSE 'False' END) AS user_key
        FROM {customer}""",
    "default_fill": """
        SELECT CAST(user_id AS STRING) AS user_id, sub, provider, NULL::VARCHAR AS email, NULL::VARCHAR AS name,
               NULL::VARCHAR AS picture, NULL::VARCHAR AS given_name, NULL::VARCHAR AS family_name,
               false AS email_verified, tier, NULL::TIMESTAMP AS latest_login,
               NULL::TIMESTAMP AS latest_pipeline_run, '03:00:00' AS cron_time, 'Europe/Amsterdam' AS timezone
        FROM {fx_users}""",
    "enum_check": """
        SELECT user_id, tier, coalesce(tier IN ('Free', 'Premium'), false) AS enum_valid FROM {fx_users}""",
    "epoch_convert": """
        SELECT event_id, epoch_us(ts) // 1000000 AS epoch_s, epoch_us(ts) // 1000 AS epoch_ms,
               date_trunc('second', ts) AS back
        FROM {events}""",
    "utc_normalize": """
        SELECT event_id, ts - INTERVAL 1 HOUR * [0, 2, 9, -5, -5, 3, 9, 9, 1, 0][event_id % 10 + 1] AS utc
        FROM {events}""",
    "date_path": """
        SELECT event_id, strftime(ts, '%Y/%m/%d') AS day_path, strftime(ts, '%Y/%m/%d/%H%M') AS minute_path
        FROM {events}""",
    "run_duration": """
        SELECT run_id, (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS seconds
        FROM {fx_runs} WHERE finished_at <> TIMESTAMP '1970-01-01 00:00:00'""",
    "timezone_check": "SELECT user_id, timezone, timezone <> 'Mars/Olympus' AS zone_valid FROM {fx_users}",
    # ingestion
    "month_plan": """
        SELECT account_id, username, year(m) AS year, month(m) AS month,
               'https://api.chess.com/pub/player/' || username || '/games/' || strftime(m, '%Y/%m') AS url
        FROM (SELECT account_id, username, unnest(generate_series(
                  date_trunc('month', coalesce(latest_ingestion, TIMESTAMP '2005-01-01 00:00:00'))::TIMESTAMP,
                  TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 MONTH)) AS m
              FROM {fx_since})""",
    "range_plan": """
        SELECT *, 'https://lichess.org/api/games/user/' || username AS url,
               epoch_us(latest_ingestion) // 1000 AS since_ms,
               epoch_us(TIMESTAMP '2024-01-31 00:00:00') // 1000 AS until_ms
        FROM {fx_since}""",
    "incremental_since": """
        SELECT event_id, e.user_id, end_time
        FROM (SELECT *, CASE WHEN event_id % 50 <> 0 THEN epoch_us(ts) // 1000000 END AS end_time FROM {events}) e
        LEFT JOIN {fx_account_state} a ON e.user_id = a.user_id
        WHERE coalesce(end_time, 0) >= coalesce(epoch_us(latest_ingestion) // 1000000, 0)""",
    "game_flatten": _FLAT,
    "ndjson_read": _FLAT,
    "games_explode": """
        SELECT event_id, url, end_time, white_username AS white FROM {fx_games} WHERE event_id % 4 >= 2
        UNION ALL
        SELECT event_id, url, end_time, white_username FROM {fx_games} WHERE event_id % 4 = 3""",
    "landing_write": """
        SELECT user_id AS account_id, url, end_time, '2024-01-31' AS ingest_date FROM {fx_games}""",
    "landing_load_since": "SELECT user_id AS account_id, url, end_time FROM {fx_games}",
    "landing_load_since_all": "SELECT user_id AS account_id, url, end_time FROM {fx_games}",
    "landing_load": f"SELECT *, 'json' AS source_file FROM ({_FLAT})",
    "ingest_batch_games": f"""
        WITH flat AS ({_FLAT}),
        held AS (SELECT * EXCLUDE (n) FROM (
            SELECT *, row_number() OVER (PARTITION BY external_game_id ORDER BY external_game_id, played_at NULLS FIRST,
                white_username, black_username, white_rating, black_rating, result, time_control,
                pgn NULLS FIRST) AS n
            FROM flat WHERE external_game_id LIKE '%7') WHERE n = 1),
        recent AS ({_SINCE}),
        fresh AS (
            SELECT url AS external_game_id, make_timestamp(end_time * 1000000) AS played_at, white_username,
                   black_username, white_rating, black_rating, white_result AS result, time_control, pgn
            FROM recent WHERE url NOT IN (SELECT external_game_id FROM held))
        SELECT *, 'old' AS source_file FROM held
        UNION ALL
        SELECT * EXCLUDE (n), NULL FROM (
            SELECT *, row_number() OVER (PARTITION BY external_game_id ORDER BY played_at NULLS LAST,
                white_username, black_username, white_rating, black_rating, result, time_control,
                pgn NULLS FIRST) AS n
            FROM fresh) WHERE n = 1""",
    "ingest_batch_watermarks": f"""
        WITH recent AS ({_SINCE})
        SELECT a.user_id AS account_id, 'user_' || CAST(a.user_id AS STRING) AS username, 'Lichess' AS platform,
               CASE WHEN a.user_id IN (SELECT user_id FROM recent) THEN TIMESTAMP '2024-01-31 00:00:00'
                    ELSE a.latest_ingestion END AS latest_ingestion
        FROM {{fx_account_state}} a""",
    "ingest_stream": "SELECT DISTINCT url AS external_game_id, 1::BIGINT AS n_rows FROM {fx_games}",
    "ingest_stream_restart": "SELECT DISTINCT url AS external_game_id FROM {fx_games}",
    "sync_partitions": """
        WITH days AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS day, value
                      FROM {events})
        SELECT event_id, day, CASE WHEN event_id % 3 = 0 AND (day IS NULL OR CAST(substr(day, 9, 2) AS INT) % 7 < 2)
                                   THEN 0.0::DOUBLE ELSE value END AS value
        FROM days""",
    "ingest_stream_counts": """
        SELECT 2 * count(*) AS rows_read, 0::BIGINT AS rows_rejected, 2 * count(DISTINCT url) AS rows_distinct,
               count(DISTINCT url) AS rows_inserted FROM {fx_games}""",
    "sync_partitions_full": f"""
        WITH days AS ({_EVENT_DAYS}), chosen AS (SELECT * FROM days WHERE day IS NULL OR dom % 7 < 2)
        SELECT event_id, day, 0.0::DOUBLE AS value FROM chosen WHERE event_id % 3 = 0
        UNION ALL SELECT -event_id, day, value FROM chosen WHERE event_id % 5 = 1""",
    "sync_partitions_touched": f"""
        WITH days AS ({_EVENT_DAYS}), chosen AS (SELECT * FROM days WHERE day IS NULL OR dom % 7 < 2)
        SELECT event_id, day, 0.0::DOUBLE AS value FROM chosen WHERE event_id % 3 = 0
        UNION ALL SELECT -event_id, day, value FROM chosen WHERE event_id % 5 = 1
        UNION ALL SELECT event_id, day, value FROM days WHERE dom % 7 >= 2""",
    "sync_partitions_delete": f"""
        SELECT event_id, day, value FROM ({_EVENT_DAYS})
        WHERE day IS NULL OR dom % 7 > 1 OR (dom % 7 = 1 AND event_id % 3 <> 0)""",
    "stream_dedupe": "SELECT DISTINCT url AS external_game_id, 1::BIGINT AS n_rows FROM {fx_games}",
    "stream_dedupe_rejects": """
        SELECT DISTINCT 'game' AS kind, url AS id, 1::BIGINT AS n_rows FROM {fx_games} WHERE event_id % 7 <> 0
        UNION ALL SELECT 'reject', url, count(*) FROM {fx_games} WHERE event_id % 7 = 0 GROUP BY url""",
    # ledger
    "run_outcome": f"SELECT run_id, result FROM ({_OUTCOME})",
    "run_errors": """
        SELECT run_id, event_id, name || ': ' || error_message AS error FROM {fx_steps} WHERE error_message <> ''""",
    "step_order": f"SELECT run_id, event_id, step_order FROM ({_NUMBERED})",
    "step_order_sliced": f"SELECT run_id, event_id, step_order FROM ({_NUMBERED})",
    "lock_conflicts": """
        SELECT b.run_id, b.name, b.user_id, b.started_at, max(a.until) AS held_until,
               max(struct_pack(u := a.until, r := a.run_id)).r AS held_by
        FROM (SELECT *, least(CASE WHEN finished_at = TIMESTAMP '1970-01-01 00:00:00' THEN TIMESTAMP '2024-01-31 00:00:00'
                                   ELSE finished_at END, started_at + INTERVAL '1' HOUR) AS until FROM {fx_ledger}) a
        JOIN {fx_ledger} b ON a.name IS NOT DISTINCT FROM b.name AND a.user_id IS NOT DISTINCT FROM b.user_id
            AND (a.started_at < b.started_at OR (a.started_at = b.started_at AND a.run_id < b.run_id))
            AND a.until > b.started_at
        GROUP BY b.run_id, b.name, b.user_id, b.started_at""",
    # references, profiles, ragged records
    "cascade_delete": """
        WITH n AS (SELECT * FROM {nation} WHERE n_regionkey <> 1),
        c AS (SELECT * FROM {customer} WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)),
        gone_c AS (SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)),
        gone_o AS (SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM gone_c))
        SELECT 'region' AS "table", CAST(r_regionkey AS VARCHAR) AS "key" FROM {region} WHERE r_regionkey <> 1
        UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM n
        UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM c
        UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM {orders} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone_o)
        UNION ALL SELECT 'lineitem', l_orderkey || ',' || l_linenumber FROM {lineitem}
                  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone_o)""",
    "cascade_ring": """
        WITH RECURSIVE links AS (
            SELECT 'supplier' AS up, nullif(s_suppkey // 2, 0) AS u, 'supplier' AS down, s_suppkey AS d FROM {supplier}
            UNION ALL SELECT 'part', nullif(s_suppkey % 11, 0) * 3, 'supplier', s_suppkey FROM {supplier}
            UNION ALL SELECT 'supplier', p_partkey // 4, 'part', p_partkey FROM {part}),
        gone(t, k) AS (
            SELECT 'supplier', s_suppkey FROM {supplier} WHERE s_suppkey = 9
            UNION SELECT down, d FROM gone JOIN links ON up = t AND u = k),
        held AS (SELECT 'supplier' AS t, s_suppkey AS k FROM {supplier} UNION ALL SELECT 'part', p_partkey FROM {part})
        SELECT t AS "table", k AS "key" FROM held WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.t = held.t AND g.k = held.k)""",
    "reference_check": """
        WITH r AS (SELECT * FROM {region} WHERE r_regionkey % 9 <> 1), n AS (SELECT * FROM {nation} WHERE n_nationkey % 9 <> 1),
        c AS (SELECT * FROM {customer} WHERE c_custkey % 9 <> 1), o AS (SELECT * FROM {orders} WHERE o_orderkey % 9 <> 1)
        SELECT 'nation' AS "table", 'n_regionkey' AS columns, 'region' AS parent, count(*) AS n_bad
        FROM n WHERE n_regionkey NOT IN (SELECT r_regionkey FROM r)
        UNION ALL SELECT 'customer', 'c_nationkey', 'nation', count(*) FROM c WHERE c_nationkey NOT IN (SELECT n_nationkey FROM n)
        UNION ALL SELECT 'orders', 'o_custkey', 'customer', count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
        UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders', count(*) FROM {lineitem}
                  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)""",
    "table_profile": """
        WITH e AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN event_type END AS event_type,
                          user_id + CASE WHEN event_id % 10 = 0 THEN 40000 ELSE 0 END AS user_id FROM {events})
        SELECT 'event_id' AS "column", count(*) AS n_rows, 0::BIGINT AS n_null, 0::BIGINT AS n_bad,
               CAST(min(event_id) AS VARCHAR) AS low, CAST(max(event_id) AS VARCHAR) AS high FROM e
        UNION ALL SELECT 'event_type', count(*), count(*) FILTER (WHERE event_type IS NULL), 0, min(event_type), max(event_type) FROM e
        UNION ALL SELECT 'user_id', count(*), count(*) FILTER (WHERE user_id IS NULL), count(*) FILTER (WHERE user_id > 32767),
               CAST(min(user_id) FILTER (WHERE user_id <= 32767) AS VARCHAR),
               CAST(max(user_id) FILTER (WHERE user_id <= 32767) AS VARCHAR) FROM e""",
    "ragged_records": """
        WITH j AS (SELECT event_id, record, CASE WHEN json_valid(record) AND json_type(record) = 'OBJECT' THEN record END AS r FROM {fx_ragged})
        SELECT event_id, CAST(json_extract_string(r, '$.id') AS BIGINT) AS id, json_extract_string(r, '$.kind') AS kind,
               CAST(json_extract_string(r, '$.user') AS BIGINT) AS "user",
               CASE WHEN len(list_filter(json_keys(r), lambda k: k NOT IN ('id', 'kind', 'user'))) > 0 THEN
                   chr(123) || array_to_string(list_transform(
                       list_sort(list_filter(json_keys(r), lambda k: k NOT IN ('id', 'kind', 'user'))),
                       lambda k: '"' || k || '":' || CAST(json_extract(r, '$.' || k) AS VARCHAR)), ',') || chr(125) END AS rest,
               CASE WHEN r IS NULL THEN record END AS bad_json
        FROM j""",
    "ragged_fields": """
        WITH j AS (SELECT record AS r FROM {fx_ragged} WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
        k AS (SELECT r, unnest(json_keys(r)) AS field FROM j)
        SELECT field, CASE field WHEN 'id' THEN 'BIGINT' WHEN 'user' THEN 'BIGINT' WHEN 'kind' THEN 'STRING'
               WHEN 'tags' THEN 'ARRAY<STRING>' WHEN 'deep' THEN 'OBJECT<on: BOOLEAN>' ELSE 'VOID' END AS type, count(*) AS n
        FROM k GROUP BY field""",
    "ledger_write": f"""
        SELECT l.run_id, l.name, l.user_id,
               CASE WHEN l.result = 'in_progress' THEN o.result ELSE l.result END AS result, l.started_at,
               CASE WHEN l.result = 'in_progress' THEN TIMESTAMP '2024-01-31 00:00:00' ELSE l.finished_at END
               AS finished_at
        FROM {{fx_ledger}} l JOIN ({_OUTCOME}) o ON o.run_id = l.run_id""",
    "ledger_write_steps": f"""
        SELECT run_id, step_order, name, result, started_at, finished_at, error_message FROM ({_NUMBERED})""",
    "active_locks": """
        SELECT run_id, user_id, started_at FROM {fx_runs} r
        WHERE finished_at = TIMESTAMP '1970-01-01 00:00:00'
          AND EXISTS (SELECT 1 FROM {fx_users} u
                      WHERE CASE WHEN u.tier IS NOT NULL THEN u.user_id END IS NOT DISTINCT FROM r.user_id)""",
    "lock_check": """
        SELECT 'ingest' AS name, u.user_id,
               CASE WHEN max(r.started_at) > TIMESTAMP '2024-01-28 00:00:00' THEN 'blocked'
                    WHEN count(r.run_id) > 0 THEN 'stale' ELSE 'free' END AS status,
               min(CASE WHEN r.started_at > TIMESTAMP '2024-01-28 00:00:00' THEN r.started_at END) AS locked_at
        FROM (SELECT DISTINCT CASE WHEN tier IS NOT NULL THEN user_id END AS user_id FROM {fx_users}) u
        LEFT JOIN {fx_runs} r ON r.user_id IS NOT DISTINCT FROM u.user_id
                             AND r.finished_at = TIMESTAMP '1970-01-01 00:00:00'
        GROUP BY u.user_id""",
    "lock_staleness": """
        SELECT run_id, user_id, started_at,
               CASE WHEN started_at > TIMESTAMP '2024-01-28 00:00:00' THEN 'fresh' ELSE 'stale' END AS lock
        FROM {fx_runs} WHERE finished_at = TIMESTAMP '1970-01-01 00:00:00'""",
    "purge_runs": """
        SELECT * FROM {fx_runs}
        WHERE NOT (finished_at = TIMESTAMP '1970-01-01 00:00:00' AND started_at < TIMESTAMP '2024-01-30 00:00:00')""",
    "due_accounts": """
        SELECT * FROM {fx_account_state}
        WHERE latest_ingestion IS NULL OR latest_ingestion <= TIMESTAMP '2024-01-14 00:00:00'""",
    "due_users": """
        SELECT * FROM (
            SELECT user_id, timezone,
                   (CAST(d || ' ' || cron_time AS TIMESTAMP) AT TIME ZONE timezone) AT TIME ZONE 'UTC' AS due_at
            FROM {fx_users}, (VALUES ('2024-06-30'), ('2024-07-01'), ('2024-07-02')) AS days(d)
            WHERE timezone <> 'Mars/Olympus')
        WHERE due_at >= TIMESTAMP '2024-07-01 00:00:00' AND due_at < TIMESTAMP '2024-07-01 18:00:00'""",
    "bad_schedules": """
        SELECT * FROM (SELECT user_id, timezone, CASE WHEN user_id % 7 = 0 THEN 'noon' WHEN user_id % 11 = 0 THEN NULL
                                                      ELSE cron_time END AS cron_time FROM {fx_users})
        WHERE timezone = 'Mars/Olympus' OR try_cast(cron_time AS TIME) IS NULL""",
    # logs
    "log_read": """
        SELECT ts, level, logger, msg, CAST(log_id AS STRING) AS log_id, 'test' AS environment, exc_type,
               NULL::VARCHAR AS exc_msg, NULL::VARCHAR AS traceback
        FROM {fx_logs}""",
    "log_tail": f"""
        SELECT {_LOG} FROM (
            SELECT *, row_number() OVER (PARTITION BY logger ORDER BY ts DESC, log_id DESC) AS n FROM {{fx_logs}})
        WHERE n <= 80""",
    "log_retention": "SELECT * FROM {fx_logs} WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'",
    # contracts on data
    "pk_integrity": f"""
        SELECT 'duplicate_key' AS "check", 'l_orderkey,l_linenumber' AS columns, count(*) AS n_bad
        FROM (SELECT {_PK} FROM {{lineitem}} GROUP BY {_PK} HAVING count(*) > 1)
        UNION ALL SELECT 'null', 'l_orderkey', count(*) FILTER (WHERE l_orderkey IS NULL) FROM {{lineitem}}
        UNION ALL SELECT 'null', 'l_linenumber', count(*) FILTER (WHERE l_linenumber IS NULL) FROM {{lineitem}}""",
    "duplicate_keys": f"SELECT {_PK}, count(*) AS n_rows FROM {{lineitem}} GROUP BY {_PK} HAVING count(*) > 1",
    "schema_diff": _DIFF,
    "schema_diff_verdict": "SELECT false AS is_match, true AS is_destructive",
    "contract_check": """
        SELECT 'only_in_data' AS rule, 'o_orderdate' AS "column", 'timestamp_ntz' AS detail, 0 AS n_bad
        UNION ALL SELECT 'only_in_contract', 'o_source', 'string', 0
        UNION ALL SELECT 'id_columns', 'o_source', 'not in the data', 0
        UNION ALL SELECT 'default', 'o_totalprice', 'None for 0.5', 0
        UNION ALL SELECT 'type', 'o_custkey', 'bigint for string', 0
        UNION ALL SELECT 'type', 'o_orderpriority', 'string for int',
                         count(*) FILTER (WHERE try_cast(o_orderpriority AS INT) IS NULL) FROM {orders}
        UNION ALL SELECT 'domain', 'o_orderstatus', 'outside F|O', count(*) FILTER (WHERE o_orderstatus = 'P')
                  FROM {orders}""",
    "schema_reconcile": """
        SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, o_totalprice, 'api' AS o_source,
               NULL::VARCHAR AS o_note
        FROM {orders}""",
    # jobs
    "table_transform": """
        SELECT event_id, strftime(ts, '%Y/%m/%d') AS day, value * 2 AS value, 'events' AS origin
        FROM {events} WHERE event_type = 'click'""",
    "nightly_maintenance": """
        SELECT 'runs' AS part, count(*) AS n_rows FROM {fx_runs}
        WHERE NOT (finished_at = TIMESTAMP '1970-01-01 00:00:00' AND started_at < TIMESTAMP '2024-01-30 00:00:00')
        UNION ALL SELECT 'links', count(*) FROM {fx_bridge}
                  WHERE account_id IN (SELECT account_id FROM {fx_accounts})
        UNION ALL SELECT 'orphans', count(*) FROM {fx_accounts}
                  WHERE account_id NOT IN (SELECT account_id FROM {fx_bridge})
        UNION ALL SELECT 'logs', count(*) FROM {fx_logs} WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'""",
}

ORACLE: dict[str, str] = {name: duck(sql) for name, sql in _SQL.items()}
