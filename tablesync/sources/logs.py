"""JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.functions.times import text_to_utc
from tablesync.operators.dedupe import top_per_key
from tablesync.sources.landing import ndjson_read

# The fields of a log line; the last three only follow an exception.
LOG_FIELDS = ("ts", "level", "logger", "msg", "log_id", "environment", "exc_type", "exc_msg", "traceback")
TAIL_LINES = 80

LOG = T.StructType([T.StructField(name, T.StringType()) for name in LOG_FIELDS])


def log_read(spark: SparkSession, path: str, *, quarantine: bool = False) -> DataFrame:
    """Log lines as rows, ``ts`` in UTC; fields a line lacks are NULL."""
    lines = ndjson_read(spark, path, LOG, quarantine=quarantine)
    return lines.withColumn("ts", text_to_utc(F.col("ts")))


def log_tail(
    logs: DataFrame, by: str = "logger", lines: int = TAIL_LINES, tie: str = "log_id", *, ordered: bool = False
) -> DataFrame:
    """The last ``lines`` lines per ``by``; ``ordered`` sorts them, oldest first inside each."""
    kept = top_per_key(logs, [by], [F.col("ts").desc(), F.col(tie).desc()], lines)
    return kept.orderBy(by, "ts", tie) if ordered else kept
