"""Matches of patterns in whole texts, with their places and neighbourhood, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablesync.llm.common import indices, whole

CONTEXT = 48


def find_spans(
    docs: DataFrame, doc_id: Column, text: Column, patterns: dict[str, str], keep: tuple[Column, ...] = ()
) -> DataFrame:
    """One row per leftmost non-overlapping match: doc_id, row (hash of the text), kind (a key of
    ``patterns``), start, end (code points, end exclusive), value, before, after (neighbouring text up to
    the next match), and the columns in ``keep``. Rows that repeat id and text give their matches once.

    Spark finds matches but not their places; the pieces between matches give those as running sums over
    the matches of one text, so the work is linear in a text's length and its matches.
    """
    plain = docs.select(doc_id.cast("long").alias("doc_id"), whole(text).alias("text"), *keep)
    names = [c for c in plain.columns if c != "text"]
    found = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("values"),
            F.split("text", pattern, -1).alias("gaps"),
        )
        for kind, pattern in patterns.items()
    ]
    matched = (
        plain.withColumn("row", F.xxhash64("text"))
        .select(*names, "row", F.explode(F.filter(F.array(*found), lambda m: F.size(m["values"]) > 0)).alias("m"))
        .select(*names, "row", "m.kind", F.col("m.values").alias("values"), F.col("m.gaps").alias("gaps"))
    )
    items = F.transform(
        indices(F.size("values")),
        lambda i: F.struct(
            i.alias("at"),
            F.length(F.get("gaps", i)).alias("gap"),
            F.get("values", i).alias("value"),
            F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )
    rows = matched.select(*names, "row", "kind", F.explode(items).alias("i")).select(*names, "row", "kind", "i.*")
    once = rows.dropDuplicates(["doc_id", "row", "kind", "at"])
    so_far = Window.partitionBy("doc_id", "row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("value")).over(so_far).cast("long")
    return once.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("at", "gap")


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.reverse(digits)
    total = F.aggregate(
        indices(F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + F.when(i % 2 == 0, _digit(reverse, i)).otherwise(2 * _digit(reverse, i) - F.when(_digit(reverse, i) > 4, 9).otherwise(0)),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def _digit(digits: Column, i: Column) -> Column:
    return F.ascii(F.substring(digits, i + 1, F.lit(1))) - F.lit(48)


def share(pattern: str, text: Column) -> Column:
    """Characters of ``text`` that match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
