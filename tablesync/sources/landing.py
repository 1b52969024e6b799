"""The landing zone: JSON-lines files, written once and read with their lineage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.errors import ContractError
from tablesync.operators.outcome import gathered

CORRUPT = "_corrupt_record"
# Half-written files (.tmp) never match.
LANDED = "*.{json,jsonl}"
BUCKETS = 16


def ndjson_read(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, *, quarantine: bool = False
) -> DataFrame:
    """One JSON object per line; blank lines are skipped.

    A malformed line fails the whole read. With ``quarantine`` it comes back as a
    row whose text is in ``_corrupt_record`` and whose other columns are NULL.
    """
    if not quarantine:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(wide)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def landing_load(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    *,
    quarantine: bool = False,
    since: date | str | None = None,
    until: date | str | None = None,
) -> DataFrame:
    """Every landed file under ``root``, with ``source_file`` (its name) and ``source_path``.

    The folders ``landing_write`` makes come back as columns, ``ingest_date`` and, where
    they are there, further ones such as ``account_id``. ``since`` and ``until`` are the
    first and last ``ingest_date`` to read; folders of other days are not opened.
    """
    reader = spark.read.option("pathGlobFilter", LANDED)
    if quarantine:
        fields = [*schema.fields, T.StructField(CORRUPT, T.StringType())]
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        schema = T.StructType(fields)
    else:
        reader = reader.option("mode", "FAILFAST")
    reader = reader.schema(schema)
    try:
        loaded = reader.json(root)
        foldered = len(loaded.columns) > len(schema)
    except SparkRuntimeException as error:
        if error.getCondition() != "CONFLICTING_DIRECTORY_STRUCTURES":
            raise
        foldered = False
    if not foldered:
        # Folders that name no columns, or not the same ones throughout: read at any depth.
        loaded = reader.option("recursiveFileLookup", "true").json(root)
    if "ingest_date" in loaded.columns:
        day = F.col("ingest_date")
        loaded = loaded.where(day >= F.lit(since).cast("date")) if since is not None else loaded
        loaded = loaded.where(day <= F.lit(until).cast("date")) if until is not None else loaded
    elif since is not None or until is not None:
        raise ContractError(f"{root} has no ingest_date folders")
    return loaded.select(
        "*",
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_path").alias("source_path"),
    )


def landing_write(
    records: DataFrame,
    root: str,
    ingest_date: str,
    *,
    partition_by: Sequence[str] = ("ingest_date",),
    bucket_by: str | None = None,
    buckets: int = BUCKETS,
    max_records_per_file: int = 1_000_000,
) -> None:
    """Append records as JSON lines under ``root``; no records, no files.

    Spark's commit moves finished files into place, so a reader never sees half of
    one. Files go by day only: a folder per account would mean one tiny file per
    account and task. The account stays in the record; pass
    ``("account_id", "ingest_date")`` for a folder per account.

    That is for few accounts: every folder costs its own file, move and listing. With
    ``bucket_by="account_id"`` the accounts share ``buckets`` folders
    (``account_id_bucket=7``) however many they are, and stay in the record, NULL as well.
    """
    dated = records.withColumn("ingest_date", F.lit(ingest_date).cast("date"))
    if bucket_by is not None:
        bucket = f"{bucket_by}_bucket"
        dated = dated.withColumn(bucket, F.pmod(F.xxhash64(bucket_by), F.lit(buckets)).cast("int"))
        partition_by = (bucket, *partition_by)
    if len(partition_by) > 1:
        dated = gathered(dated, partition_by)
    writer = dated.write.mode("append").partitionBy(*partition_by)
    writer.option("maxRecordsPerFile", max_records_per_file).json(root)
