"""Quality rules by cross-document line frequency.

Lines are normalised and hashed with their host, and the distinct documents that hold a line are
counted per host. A line above the limit is boilerplate; a document left with too few words outside
such lines is depleted and rejected, beside documents that fail the base rules.

Copies of one document are no boilerplate: documents with the same normalised lines count as one body, and
a line is limited if more than ``max_documents`` bodies of its host hold it. Copies stay for near-duplicate
removal to decide.

Defined results: NULL or empty text has no words and fails the base rules. A NULL host is a host of
its own. Rows with the same id are one document in the line counts and keep a row each. Other columns
are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import NOT_SPACE, by_merge, cut, indices, lower_ascii, spare, strip_space, whole, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCUMENTS = 20
MIN_LEFT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value standing in a one-row array: it is computed once, however often it is used
    and wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words in windows found twice or more. Equal windows are neighbours once the hashes are sorted with their
    places: linear memory and n log n time in the length of one text."""

    def covered(twice: Column) -> Column:
        return F.aggregate(
            F.array_sort(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def neighbours(placed: Column) -> Column:
        return F.filter(placed, lambda x, j: (F.get(placed, j - 1)["h"] == x["h"]) | (F.get(placed, j + 1)["h"] == x["h"]))

    def counted(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeated, _once(placed, lambda p: covered(neighbours(p)))).otherwise(0)

    windows = F.transform(
        indices(F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))
    )
    return _once(windows, counted)


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the base counts of each whole text and ``base_failed``."""
    given = F.col(text)
    spoken = F.filter(F.split(whole(given), "\n", -1), lambda line: line.rlike(NOT_SPACE))
    of_words = _once(
        words_of(given),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).cast("long").alias("repeated")),
    )
    of_lines = _once(spoken, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return (
        docs.withColumn("_of_words", of_words)
        .select(
            *(docs[c] for c in docs.columns),
            F.col("_of_words.n").alias("n_words"),
            F.length(F.translate(whole(given), " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(whole(given)) - F.length(F.translate(whole(given), SYMBOLS, ""))).cast("long").alias("n_symbols"),
            of_lines.cast("long").alias("n_dup_lines"),
            F.col("_of_words.repeated").alias("n_repeat_words"),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        )
    )


def line_rows(docs: DataFrame, doc_id: Column, text: Column, host: Column) -> DataFrame:
    """One row per line of each text that has a word: id, hash of the text, body (hash of all normalised lines),
    place among all lines, hash of host and normalised line, and its number of words."""
    plain = docs.select(doc_id.alias("id"), whole(text).alias("text"), host.alias("host"))
    keyed = plain.select(
        "id",
        "host",
        F.xxhash64("text").alias("body_of_row"),
        F.transform(F.split("text", "\n", -1), lambda line: lower_ascii(strip_space(line))).alias("lines"),
    )
    body = F.array_join(F.filter("lines", lambda x: x != ""), "\n")
    exploded = keyed.withColumn("body", F.xxhash64(body)).select(
        "id", "host", "body_of_row", "body", F.posexplode("lines").alias("at", "line")
    )
    return exploded.where("line <> ''").select(
        "id",
        "body_of_row",
        "body",
        "at",
        F.xxhash64("host", "line").alias("key"),
        F.size(words_of(F.col("line"))).alias("words"),
    )


def limited_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """Hashes of the lines above the limit. Each grouping combines rows before it moves them."""
    documents = rows.groupBy("key", "id").agg(F.min("body").alias("body"))
    bodies = documents.select("key", "body").distinct()
    counted = bodies.groupBy("key").agg(F.count("*").alias("bodies"))
    return counted.where(F.col("bodies") > max_documents).select("key")


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS,
    min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """Id, text, base counts, ``base_failed``, ``limited_words`` and ``limited_places`` (words in and places of
    lines above the limit, NULL for no places) and ``kept``."""
    rows = line_rows(docs, docs[doc_id], docs[text], docs[host])
    limited = cut(limited_lines(rows, max_documents), "limited_lines")
    # Rows that repeat id and text repeat each place; it counts once.
    places = rows.join(limited, "key").groupBy("id", "body_of_row", "at").agg(F.max("words").alias("words"))
    depleted = cut(
        places.groupBy("id", "body_of_row").agg(
            F.sum("words").alias("limited_words"), F.collect_set("at").alias("limited_places")
        ),
        "depleted",
    )
    measured = base_measures(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    judged = measured.withColumn("_row", F.xxhash64(whole(F.col("text"))))
    joined = judged.join(
        depleted, judged["doc_id"].eqNullSafe(depleted["id"]) & (judged["_row"] == depleted["body_of_row"]), "left"
    ).drop("id", "body_of_row", "_row")
    left = F.col("n_words") - F.coalesce("limited_words", F.lit(0))
    return joined.withColumn("limited_words", F.coalesce("limited_words", F.lit(0))).withColumn(
        "kept", ~F.col("base_failed") & (100 * left >= min_left_percent * F.col("n_words"))
    )


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` without the documents that ``quality_rules`` rejects, and without the lines above the limit in
    those it keeps. Rows are told apart by id and text."""
    judged = quality_rules(docs, doc_id, text, host)
    gone_id, gone_row, kept, places, lines = spare(docs, "_gone_id", "_gone_row", "_kept", "_places", "_lines")
    changed = cut(
        judged.where(~F.col("kept") | F.col("limited_places").isNotNull())
        .select(
            F.col("doc_id").alias(gone_id),
            F.xxhash64(whole(F.col("text"))).alias(gone_row),
            F.col("kept").alias(kept),
            F.when(F.col("kept"), F.col("limited_places")).alias(places),
        )
        .dropDuplicates([gone_id, gone_row]),
        "rejected",
    )
    row = F.xxhash64(whole(docs[text]))
    joined = docs.join(
        by_merge(changed), docs[doc_id].eqNullSafe(F.col(gone_id)) & (row == F.col(gone_row)), "left"
    ).where(F.coalesce(kept, F.lit(True)))
    lined = joined.withColumn(lines, F.split(whole(docs[text]), "\n", -1))
    left = F.transform(F.array_except(indices(F.size(lines)), F.col(places)), lambda i: F.get(lines, i))
    shortened = F.when(F.col(places).isNotNull(), F.array_join(left, "\n")).otherwise(docs[text])
    return lined.withColumn(text, shortened).select(docs.columns)
