"""Document fingerprints by Order MinHash.

A text's k-mers are runs of ``KMER`` words, numbered by occurrence, so that a repeated k-mer counts as often
as it occurs. A hash deals the numbered k-mers to ``BINS`` bins; in each, the ``PICKED`` smallest are
selected, put back into text order and hashed as one tuple. The tuples are the fingerprint: moving words
about changes it as well as replacing them. Likeness is the share of equal tuples among the bins that
either text fills.

Everything is array functions of one row: a sort of the text's k-mers, linear memory.

Defined results: NULL is the empty text. A text without words has the empty fingerprint; two of them have
likeness 1, one beside another text 0. A text of fewer than ``KMER`` words is one k-mer. The next document
is the one with the next larger id, NULL first; rows that repeat an id follow one another, by hash of
their texts, and rows that repeat id and text share a place and have a row each. A single document is its
own next. Other columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import cut, indices, numbered, whole, words_of

KMER = 5
BINS = 64
PICKED = 2


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: an array of ints, bin in the low bits and tuple hash above, by bin."""
    words, n = "_words", F.size("_words")
    gram = F.when(
        n >= KMER,
        F.transform(indices(n - (KMER - 1)), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(KMER)))),
    ).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<long>"))

    def element(gram_hash: Column, occurrence: Column, place: Column) -> Column:
        rank = F.xxhash64(gram_hash, occurrence.cast("int"))
        return F.struct(
            rank.bitwiseAND(F.lit(BINS - 1).cast("long")).alias("bin"), rank.alias("rank"), place.alias("place")
        )

    # Only a text in which a k-mer comes twice needs the sort that numbers occurrences.
    placed = F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    starts = F.filter(
        indices(F.size("_placed")), lambda j: (j == 0) | (F.get("_placed", j - 1)["h"] != F.get("_placed", j)["h"])
    )
    runs = F.transform(
        "_starts",
        lambda s, r: F.transform(
            F.slice("_placed", s + 1, F.coalesce(F.get("_starts", r + 1), F.size("_placed")) - s),
            lambda x, occurrence: element(x["h"], occurrence, x["i"]),
        ),
    )
    ranked = F.array_sort(
        F.when(F.col("_placed").isNull(), F.transform("_grams", lambda h, i: element(h, F.lit(0), i))).otherwise(
            F.flatten(runs)
        )
    )
    heads = F.filter(
        indices(F.size("_ranked")), lambda j: (j == 0) | (F.get("_ranked", j - 1)["bin"] != F.get("_ranked", j)["bin"])
    )

    def picked(j: Column) -> Column:
        # slice() over the bin's first elements, back in text order
        mine = F.filter(
            F.slice("_ranked", j + 1, F.lit(PICKED)), lambda x: x["bin"] == F.get("_ranked", j)["bin"]
        )
        ordered = F.array_sort(F.transform(mine, lambda x: F.struct(x["place"].alias("p"), x["rank"].alias("r"))))
        tuple_hash = F.xxhash64(F.transform(ordered, lambda x: x["r"]))
        # 26 bits of the hash above 6 bits of the bin, as an int
        return (
            F.shiftright(tuple_hash, 38).bitwiseAND(F.lit((1 << 26) - 1).cast("long")) * BINS
            + F.get("_ranked", j)["bin"]
            - F.lit(1 << 31)
        ).cast("int")

    return (
        df.withColumn("_words", words_of(F.col(text)))
        .withColumn("_grams", gram)
        .withColumn("_placed", placed)
        .withColumn("_starts", F.when(F.col("_placed").isNotNull(), starts))
        .withColumn("_ranked", ranked)
        .withColumn("_heads", heads)
        .withColumn(name, F.transform("_heads", picked))
        .drop("_words", "_grams", "_placed", "_starts", "_ranked", "_heads")
    )


def likeness(a: Column, b: Column) -> Column:
    bins = lambda x: F.transform(x, lambda e: e.bitwiseAND(F.lit(BINS - 1)))
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda e: F.lpad(F.lower(F.hex(e.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def next_in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_chars) of ``docs``, once each, with ``next_id`` and ``next_row``; after the last comes the first."""
    order = F.col("doc_id").asc_nulls_first()
    chain = cut(numbered(docs.select("doc_id", "row", "n_chars").distinct(), order, F.col("row")), "chain")
    size = max(chain.count(), 1)
    after = chain.select(
        F.col("doc_id").alias("next_id"), F.col("row").alias("next_row"), F.pmod(F.col("n") - 1, F.lit(size)).alias("n")
    )
    return chain.join(after, "n").drop("n")


def edited_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document, its fingerprint and edited text, and the next document's fingerprint: doc_id, n_chars,
    text, print, edited, next_print. The edited text's second half is the beginning of the next document.

    Whole texts move once: the exchange by id serves the join that gives beginnings away and the one that
    takes them in.
    """
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), whole(docs[text]).alias("text"))
    sized = plain.select("doc_id", F.xxhash64("text").alias("row"), F.length("text").alias("n_chars"))
    links = cut(next_in_order(sized), "next_documents")
    marked = with_fingerprint(plain.withColumn("row", F.xxhash64("text")), "text", "print")
    asked = links.select(
        F.col("next_id").alias("_id"), F.col("next_row").alias("_row"), F.col("doc_id").alias("for_id"),
        F.col("row").alias("for_row"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"),
    )
    given = marked.join(
        asked, marked["doc_id"].eqNullSafe(asked["_id"]) & (marked["row"] == asked["_row"])
    ).select(
        "for_id", "for_row", F.substring("text", F.lit(1), F.col("half")).alias("beginning"),
        F.col("print").alias("next_print"),
    )
    if sized.count() > links.count():
        given = given.dropDuplicates(["for_id", "for_row"])  # rows that repeat id and text give alike
    taken = marked.join(given, marked["doc_id"].eqNullSafe(given["for_id"]) & (marked["row"] == given["for_row"]))
    size = F.length("text")
    edited = F.concat(
        F.substring("text", F.lit(1), (size - F.floor(size / 2)).cast("int")), F.col("beginning")
    )
    return taken.select("doc_id", size.cast("long").alias("n_chars"), "text", "print", edited.alias("edited"), "next_print")
