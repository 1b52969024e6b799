"""Landing zone to games table as a stream.

Files are replayable and inserts are idempotent, which together give exactly-once
rows: each micro-batch writes a segment of the table, named after the query and the
batch, and looks for known games in all others, so a replayed batch overwrites
itself and a query with a new checkpoint adds to what is there.

A segment has a membership sketch of its ids beside it. A batch reads the sketches
and then only segments that may hold one of its ids, of those the id column, and where few ids
are in question only the pages around their hashes. Segments of like size are compacted when
``FAN_IN`` of them have gathered, so their number grows with the logarithm of the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablesync.contract import TableContract
from tablesync.operators.dedupe import dedupe_by_key
from tablesync.operators.guards import any_null
from tablesync.operators.ingest import GAME, REQUIRED, game_flatten, game_rejects
from tablesync.operators.membership import key_hash, possibly_held, sketch, words_for
from tablesync.operators.merge import absent_from
from tablesync.session import discard, scratch_dir, stored
from tablesync.sources.landing import CORRUPT, LANDED
from tablesync.swaps import Folder, aside, mend, publish

BATCH = "batch_id"
SEGMENT = "segment"
HASH = "key_hash"
IDS = "_ids"  # sketches, hidden from readers of the table: width=w/segment=s
COUNTS = "_counts"
MAX_FILE_AGE = "36500d"
FAN_IN = 8
LEAST_BYTES = 1 << 20  # segments below are of one size to compaction
FEW = 5_000  # hashes that go into a scan's filter
_SKETCH = "word long, bits long, width long, segment string"
_COUNTS = "batch_id string, rows_read long, rows_rejected long, rows_distinct long, rows_inserted long, segments long, segments_read long"


def _stream(spark: SparkSession, landing: str, max_files: int | None) -> DataFrame:
    schema = T.StructType([*GAME.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", LANDED)
        .option("columnNameOfCorruptRecord", CORRUPT)
        # Spark otherwise passes over files a week older than the newest; restored ones may be.
        # In return the names of all files read stay in the checkpoint.
        .option("maxFileAge", MAX_FILE_AGE)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(landing).select(
        "*",
        F.col("_metadata.file_name").alias("source_file"),
        F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start").alias("_block"),
    )


def _own_name(session: SparkSession, batch_id: int) -> str:
    # Numbers start again with a new checkpoint; the query's id does not repeat.
    return f"{session.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"


def _table_schema(contract: TableContract) -> T.StructType:
    more = [T.StructField(BATCH, T.StringType()), T.StructField(HASH, T.LongType()), T.StructField(SEGMENT, T.StringType())]
    return T.StructType([*contract.struct().fields, *more])


def _at(table: str) -> str:
    return table.rstrip("/")


def read_ingested(spark: SparkSession, table: str, contract: TableContract) -> DataFrame:
    """The games table a stream has written, with ``batch_id`` (query id and number of the
    micro-batch that brought a row) and its partition column ``segment``."""
    schema = _table_schema(contract)
    try:
        return spark.read.schema(schema).parquet(table).drop(HASH)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).drop(HASH)


def ingest_counts(spark: SparkSession, table: str) -> DataFrame:
    """One row per micro-batch: records read, rejected, distinct ids, games inserted, segments there and read."""
    return spark.read.schema(_COUNTS).json(f"{_at(table)}/{COUNTS}")


def _segments(folder: Folder) -> list[str]:
    return [n.partition("=")[2] for n in folder.names() if n.startswith(f"{SEGMENT}=")]


def _sketched(folder: Folder) -> dict[str, int]:
    """Width of each segment's sketch."""
    return {
        s.partition("=")[2]: int(w.partition("=")[2]) for w in folder.names(IDS) for s in folder.names(f"{IDS}/{w}")
    }


def _sketch_at(segment: str, width: int) -> str:
    return f"{IDS}/width={width}/{SEGMENT}={segment}"


def _read_segments(spark: SparkSession, table: str, contract: TableContract, segments: list[str]) -> DataFrame:
    paths = [f"{_at(table)}/{SEGMENT}={s}" for s in segments]
    return spark.read.schema(_table_schema(contract)).option("basePath", table).parquet(*paths)


def _write_segment(rows: DataFrame, root: str, segment: str, key: list[str]) -> int:
    """A segment in files of even size, each sorted by hash, then its sketch; gives the number of rows."""
    laid = rows.withColumn(HASH, key_hash(key)).hint("rebalance").sortWithinPartitions(HASH)
    path = f"{root}/{SEGMENT}={segment}"
    laid.write.mode("overwrite").parquet(path)
    written = rows.sparkSession.read.schema(laid.schema).parquet(path)
    n = written.count()
    if n:
        width = words_for(n)
        sketch(written, key, width).coalesce(1).write.mode("overwrite").parquet(f"{root}/{_sketch_at(segment, width)}")
    return n


def _may_hold(spark: SparkSession, table: str, folder: Folder, unique: DataFrame, key: list[str], segments: list[str]):
    """Segments that may hold a key of ``unique``, and the hashes in question where they are few."""
    widths = {s: w for s, w in _sketched(folder).items() if s in set(segments)}
    # A segment whose sketch was never finished may hold anything.
    blind = [s for s in segments if s not in widths]
    if not widths:
        return blind, None
    paths = [f"{_at(table)}/{_sketch_at(s, w)}" for s, w in widths.items()]
    sketches = spark.read.schema(_SKETCH).option("basePath", f"{_at(table)}/{IDS}").parquet(*paths)
    found = possibly_held(unique, key, sketches, sorted(set(widths.values())), SEGMENT)
    first = found.limit(FEW + 1).collect()
    if len(first) <= FEW:
        return sorted({r[SEGMENT] for r in first} | set(blind)), None if blind else [r[HASH] for r in first]
    return sorted({r[0] for r in found.select(SEGMENT).distinct().collect()} | set(blind)), None


def compact_ingested(spark: SparkSession, table: str, contract: TableContract, keep: str | None = None) -> None:
    """Merge segments of like size where ``FAN_IN`` have gathered, until nowhere that many have.

    A row is rewritten once per size it grows through. The swap of old for new is mended by the next batch if
    it breaks off. ``keep`` names a segment to leave alone.
    """
    folder = Folder(spark, table)
    while True:
        tiers: dict[int, list[str]] = {}
        for segment in _segments(folder):
            if segment != keep:
                size = folder.size(f"{SEGMENT}={segment}") // LEAST_BYTES
                tiers.setdefault((size.bit_length() + 2) // 3, []).append(segment)
        full = next((held for held in tiers.values() if len(held) >= FAN_IN), None)
        if full is None:
            return
        widths, staging, name = _sketched(folder), aside(), f"merged-{uuid.uuid4().hex}"
        rows = _read_segments(spark, table, contract, full).drop(SEGMENT, HASH)
        n = _write_segment(rows, f"{folder.root}/{staging}", name, list(contract.primary_key))
        put = [f"{SEGMENT}={name}", _sketch_at(name, words_for(n))]
        publish(folder, staging, put, [f"{SEGMENT}={s}" for s in full] + [_sketch_at(s, widths[s]) for s in full if s in widths])


def ingest_stream(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    contract: TableContract,
    *,
    rejects: str | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Start ingesting all new landed files, then stop.

    Games are unique by id: the earliest played of a batch wins, and a game known
    from an earlier batch is left alone. A malformed line or incomplete record
    stops the stream, or goes to ``rejects`` as JSON when that path is given.
    ``ingest_counts`` has the counts of each batch.
    """
    key = list(contract.primary_key)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = _own_name(session, batch_id)
        folder = Folder(session, table)
        mend(folder)
        compact_ingested(session, table, contract, keep=own)
        if rejects:
            # Under its own name the text would be taken for a new parse failure when read.
            aside_rows = game_rejects(batch).withColumnRenamed(CORRUPT, "line")
            aside_rows.write.mode("overwrite").json(f"{rejects}/{BATCH}={own}")
        seen = Observation()
        read = batch.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(any_null(REQUIRED)).alias("rejected"))
        games = game_flatten(read, source_file="source_file", strict=rejects is None)
        order = [F.col("played_at").asc_nulls_last(), *(c for c in games.columns if c not in (*key, "played_at"))]
        # Written out, the batch has a known size: if it is small, the look-up scans the
        # ids of the table in place instead of shuffling them.
        scratch = scratch_dir(session, "batch")
        try:
            unique = stored(dedupe_by_key(games, key, order, null_keys=False), scratch)
            others = [s for s in _segments(folder) if s != own]
            asked, hashes = _may_hold(session, table, folder, unique, key, others)
            fresh = unique
            if asked:
                known = _read_segments(session, table, contract, asked)
                known = known if hashes is None else known.where(F.col(HASH).isin(hashes))
                fresh = absent_from(unique, known, key, unique_target=True)
            fresh = fresh.select(*contract.column_names).withColumn(BATCH, F.lit(own))
            for width in folder.names(IDS):
                # Of a run that broke off, perhaps of another width.
                folder.delete(f"{IDS}/{width}/{SEGMENT}={own}")
            inserted = _write_segment(fresh, folder.root, own, key)
            if not inserted:
                folder.delete(f"{SEGMENT}={own}")
            counts = {
                "batch_id": own,
                "rows_read": seen.get["read"],
                "rows_rejected": seen.get["rejected"],
                "rows_distinct": unique.count(),
                "rows_inserted": inserted,
                "segments": len(others),
                "segments_read": len(asked),
            }
            folder.delete(f"{COUNTS}/{own}.json")
            folder.write(f"{COUNTS}/{own}.json", json.dumps(counts))
        finally:
            discard(session, scratch)

    return (
        _stream(spark, landing, max_files)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    *,
    lateness: str = "7 days",
    strict: bool = True,
    rejects: str | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Start copying new games to ``table``, dropping repeats read within ``lateness``.

    Time is when the stream reads a record, so no record is late, however old its
    file or its game. The state holds ids only, and only as long as the bound asks;
    the table is never read. Repeats are first dropped per id and block of a file,
    so an id that most records share is spread over many tasks and reaches the final
    step at most once per block. ``strict`` stops at an incomplete record; otherwise
    such records are skipped, or with ``rejects`` written there as JSON.

    Games and rejects are two outputs of one query: one handle, one checkpoint. Each batch writes its own
    partition ``batch_id`` of both, rejects first, so a failure at either stops the query and a replay
    overwrites what the failed run had written.
    """
    strict = strict and rejects is None
    read = _stream(spark, landing, max_files).withColumn("_read_at", F.current_timestamp())
    timed = game_flatten(
        read.withWatermark("_read_at", lateness), source_file="source_file", strict=strict, extra=["_read_at", "_block"]
    )
    unique = (
        timed.dropDuplicatesWithinWatermark(["external_game_id", "_block"])
        .dropDuplicatesWithinWatermark(["external_game_id"])
        .drop("_read_at", "_block")
    )
    games = unique.select(F.struct("*").alias("game"))
    if rejects:
        # Not through the state: records that are no games have no id to tell repeats by.
        left = game_rejects(_stream(spark, landing, max_files)).withColumnRenamed(CORRUPT, "line").drop("_block")
        games = games.unionByName(left.select(F.struct("*").alias("reject")), allowMissingColumns=True)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own, scratch = _own_name(session, batch_id), scratch_dir(session, "batch")
        try:
            # Both outputs from one run of the batch: a second would go through the state again.
            both = stored(batch, scratch)
            if rejects:
                aside_rows = both.where(F.col("reject").isNotNull()).select("reject.*")
                aside_rows.write.mode("overwrite").json(f"{rejects}/{BATCH}={own}")
            kept = both.where(F.col("game").isNotNull()).select("game.*")
            kept.write.mode("overwrite").parquet(f"{_at(table)}/{BATCH}={own}")
        finally:
            discard(session, scratch)

    return (
        games.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
