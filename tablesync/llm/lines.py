"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least
``min_chars`` code points in at least ``min_documents`` documents lose all their lines, except in the
document with the largest id that holds the key.

Defined results: NULL or empty text is one empty line, which is never dropped. A NULL id is a document,
smaller than every other. Rows with the same id are one document: they hold a key once and drop alike.
A text that loses all lines becomes the empty text. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import by_merge, cut, indices, lower_ascii, spare, strip_space, whole

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def line_keys(docs: DataFrame, doc_id: Column, text: Column, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: id, hash of the text, place, and the key's 128-bit hash."""
    lines = docs.select(doc_id.alias("id"), whole(text).alias("text")).select(
        "id",
        F.xxhash64("text").alias("row"),
        F.posexplode(F.split("text", "\n", -1)).alias("at", "line"),
    )
    keyed = lines.select("id", "row", "at", lower_ascii(strip_space(F.col("line"))).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "id", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def dropped_places(docs: DataFrame, doc_id: Column, text: Column, min_chars: int, min_documents: int) -> DataFrame:
    """Places of the lines to drop, per id and hash of the text."""
    keys = line_keys(docs, doc_id, text, min_chars)
    shared = cut(
        keys.select("h1", "h2", "id")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("documents"), F.max("id").alias("keeper"))
        .where(F.col("documents") >= min_documents)
        .select("h1", "h2", "keeper"),
        "shared_lines",
    )
    gone = keys.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("id", "row").agg(F.collect_set("at").alias("gone"))


def line_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and the columns ``n_lines`` (before) and ``n_dropped``.

    The place list of a text is no longer than the text; kept places are its complement by a hash set.
    A column already named ``n_lines`` or ``n_dropped`` is replaced.
    """
    row, gone_id, gone_row, gone, lines = spare(docs, "_row", "_gone_id", "_gone_row", "_gone", "_lines")
    places = cut(
        dropped_places(docs, docs[doc_id], docs[text], min_chars, min_documents).select(
            F.col("id").alias(gone_id), F.col("row").alias(gone_row), F.col("gone").alias(gone)
        ),
        "dropped_lines",
    )
    joined = docs.withColumn(row, F.xxhash64(whole(docs[text]))).join(
        by_merge(places), docs[doc_id].eqNullSafe(F.col(gone_id)) & (F.col(row) == F.col(gone_row)), "left"
    )
    lined = joined.withColumn(lines, F.split(whole(docs[text]), "\n", -1))
    kept = F.when(
        F.col(gone).isNotNull(),
        F.array_join(F.transform(F.array_except(indices(F.size(lines)), F.col(gone)), lambda i: F.get(lines, i)), "\n"),
    ).otherwise(docs[text])
    return lined.withColumns(
        {
            text: kept,
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        }
    ).drop(row, gone_id, gone_row, gone, lines)
