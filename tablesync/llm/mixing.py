"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target is its share of all words; a document's expected number of copies is target over
source size. Whole copies are certain; the fraction is an inclusion probability. Within blocks of one
source, probabilities move along the null space of two constraints, the number of documents and their
words, until at most two per block are left undecided; the undecided rows of many blocks form the next,
far smaller round. What one last block leaves, two documents at most, and the source's smallest ``LANDING``
documents left are the landing problem, of which every choice is weighed.

Defined results: NULL or empty text has size 0 and is taken 0 words. A NULL source is one source, last
in order. Rows with the same id are documents of their own, told apart by their text; equal rows share
the decisions made for their group in a fixed order. Results depend on ids, sizes and ``seed`` alone,
not on partitioning. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import by_merge, cut, numbered, ship_code, spare, words_of

LIMIT = 3.0
BLOCK_ROWS = 4096
LANDING = 10  # documents kept out of the last flight, the smallest ones
SEED = 20240601


def source_targets(sizes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Target words per source: ``source``, ``source_size``, ``target``.

    Shares go by weight 1, 2, 3, repeating in order of the names. A target stops at ``limit`` times
    the source's size and the excess is shared again. The driver sees two sums per round.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = cut(
        numbered(totals, F.col("source").asc_nulls_last()).select(
            "source", "source_size", (F.col("n") % 3 + 1).alias("weight"), (limit * F.col("source_size")).alias("cap")
        ),
        "sources",
    )
    rate = -1.0
    while True:
        full = F.col("weight") * F.lit(rate) > F.col("cap")
        total, taken, weights = ranked.agg(
            F.sum("source_size"),
            F.sum(F.when(full, F.col("cap"))),
            F.sum(F.when(~full, F.col("weight"))),
        ).first()
        new = ((total or 0) - (taken or 0.0)) / weights if weights else rate
        if new <= rate:
            break
        rate = new
    return ranked.select(
        "source", "source_size", F.least("cap", F.col("weight") * F.lit(max(rate, 0.0))).alias("target")
    )


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move ``p`` until at most two entries are fractional, keeping its sum and its size-weighted sum.

    Three fractional documents always have a direction that changes neither sum; each step moves along
    it, up or down at random with the right expectation, until one of the three is decided.
    """
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    active: list[int] = []
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1.0 - p[k]) / v if v > 0 else -p[k] / v for k, v in zip(active, u, strict=True) if v)
        down = min(p[k] / v if v > 0 else (p[k] - 1.0) / v for k, v in zip(active, u, strict=True) if v)
        step = up if draw[i] * (up + down) < down else -down
        for k, v in zip(active, u, strict=True):
            p[k] += step * v
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1.0 - 1e-9:
                p[k] = 1.0
        active = [k for k in active if 0.0 < p[k] < 1.0]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last documents: of all choices the one whose words come nearest to what is expected of
    them, then the one whose number of documents does."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(choices @ size[open_] - (p * size)[open_].sum())
    documents = np.abs(choices.sum(axis=1) - p[open_].sum())
    out = p.copy()
    out[open_] = choices[np.lexsort((documents, words))[0]]
    return out


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    # The largest first, so that what is left undecided is small.
    pdf = pdf.sort_values(["size", "draw", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
    return pdf.assign(p=flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), pdf["draw"].to_numpy()))


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "draw", "doc_id", "row"], ascending=[False, True, True, True], kind="stable")
    p, size = pdf["p"].to_numpy(), pdf["size"].to_numpy(float)
    most = max(len(p) - LANDING, 0)
    flown = np.concatenate([flight(p[:most], size[:most], pdf["draw"].to_numpy()[:most]), p[most:]])
    return pdf.assign(p=landing(flown, size))


COLUMNS = "source string, doc_id string, row long, size long, p double, draw double"


def balanced_sample(fractions: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``fractions`` (source, doc_id, row, size, p, draw) with every ``p`` moved to 0 or 1.

    ``block_rows`` bounds what one task holds. Each round leaves two rows per block, so it needs the
    logarithm of the input's rows in rounds.
    """
    ship_code(fractions.sparkSession)
    fractions = fractions.where((F.col("p") > 0) & (F.col("p") < 1))
    decided = None
    most = fractions.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while most > block_rows:
        blocks = -(-most // (block_rows // 2))
        block = F.pmod(F.xxhash64("doc_id", "row", F.lit(SEED)), F.lit(blocks))
        flown = cut(
            fractions.withColumn("_block", block)
            .groupBy("source", "_block")
            .applyInPandas(lambda pdf: _fly(pdf.drop(columns="_block")), COLUMNS),
            "flight",
        )
        done = flown.where((F.col("p") <= 0) | (F.col("p") >= 1))
        decided = done if decided is None else decided.unionByName(done)
        fractions = flown.where((F.col("p") > 0) & (F.col("p") < 1))
        most = fractions.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    landed = cut(fractions.groupBy("source").applyInPandas(_land, COLUMNS), "landing")
    return landed if decided is None else decided.unionByName(landed)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    limit: float = LIMIT,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, row (hash of its text), source, size, source_size, target, copies, taken."""
    sizes = cut(
        docs.select(
            docs[doc_id].cast("long").alias("doc_id"),
            F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("row"),
            docs[source].cast("string").alias("source"),
            F.size(words_of(docs[text])).cast("long").alias("size"),
        ),
        "sizes",
    )
    targets = cut(source_targets(sizes, limit), "targets").withColumnRenamed("source", "_source")
    # A source's target is a few numbers per row of a table with one row per source.
    rated = sizes.join(targets, sizes["source"].eqNullSafe(targets["_source"])).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.withColumn("whole", F.floor(ratio).cast("long")).withColumn("p", ratio - F.floor(ratio))
    draw = F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # Ids travel as text: pandas would round large numbers beside a NULL.
    fractions = rated.where("size > 0").select(
        "source", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "row", "size", "p", draw.alias("draw")
    )
    chosen = (
        balanced_sample(fractions, block_rows)
        .groupBy(F.expr("nullif(doc_id, '')").cast("long").alias("_id"), F.col("row").alias("_row"))
        .agg(F.sum("p").alias("_chosen"), F.count("*").alias("_rows"))
    )
    joined = rated.join(
        chosen, rated["doc_id"].eqNullSafe(F.col("_id")) & (rated["row"] == F.col("_row")), "left"
    )
    # Equal rows share what was decided for them, whole copies first.
    extra = F.coalesce(F.floor(F.col("_chosen") / F.col("_rows") + 0.5), F.lit(0)).cast("long")
    copies = F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "row", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    mix_id, mix_row, mix_copies, row, copy = spare(docs, "_mix_id", "_mix_row", "_mix_copies", "_row", "_copy")
    plan = mix(docs, doc_id, text, source).where("copies > 0").select(
        F.col("doc_id").alias(mix_id), F.col("row").alias(mix_row), F.col("copies").alias(mix_copies)
    ).distinct()
    keyed = docs.withColumn(row, F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    joined = keyed.join(by_merge(plan), keyed[doc_id].eqNullSafe(F.col(mix_id)) & (F.col(row) == F.col(mix_row)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(mix_copies).cast("int")))).select(docs.columns)
