"""SimHash near-duplicates found by multi-index hashing.

A fingerprint's bit is the majority of that bit over the hashes of a text's word shingles. Fingerprints
link at ``RADIUS`` or fewer differing bits; documents with equal fingerprints are one node throughout.

* Links of one or two bits: two such fingerprints have a common neighbour at one bit from both, so each
  fingerprint names the 65 members of its one-bit ball and those that share a member are linked to the
  smallest among them. No more than 65 fingerprints share one, and no pairs are listed.
* Longer links: of three segments, one differs by at most one bit (first two segments) or by none (last),
  since more would exceed the radius. From ``MANY`` fingerprints on, where keys of some 20 bits would be shared by
  too many, there are two segments of 32 bits with balls of two bits and of one, which finds the same links. Small balls are enumerated in those segments, matched against the
  segment table by an equi-join, and the complete distance is verified inside the join. Pairs already in
  one component are not emitted.

``near_dedup`` is wider than ``simhash_components``: beside those links it joins documents whose sets of
``WIDE_SHINGLE``-word shingles have a Jaccard similarity of at least ``MIN_SIMILAR`` percent. 40 bands of 6
MinHash values name the candidates (a pair at 0.8 shares no band once in some 190,000 times), the sketches of the 240
values dismiss those far below (``FAR``: one pair at 0.8 in some million), and every other candidate is
verified by its exact similarity.

Defined results: NULL or empty text, or one without words, has fingerprint 0. A NULL id counts only if its
component has no other. Rows that repeat an id have a row each. No rows in, no rows out. Other columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm import minhash
from tablesync.llm.common import by_merge, cut, indices, lower_ascii, ship_code, whole, words_of
from tablesync.llm.components import connected

SHINGLE = 4
RADIUS = 4
# (first bit, bits, radius of the ball): the radii plus one sum to RADIUS + 1.
SEGMENTS = ((0, 23, 1), (23, 23, 1), (46, 18, 0))
WIDE_SEGMENTS = ((0, 32, 2), (32, 32, 1))
MANY = 1 << 24
VOTE_ROWS = 1 << 16
WIDE_SHINGLE = 5
MIN_SIMILAR = 80
FAR = 75  # of 240 values; 45 are expected to differ at a similarity of 0.8, with a deviation of 6


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each run of ``size`` words, of the whole sequence if there are fewer."""
    words = words_of(lower_ascii(whole(text)))
    shingle = lambda w, i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(size))))
    # The words stand in a one-row array, so that they are split once for all shingles.
    return F.flatten(
        F.transform(
            F.array(words),
            lambda w: F.when(F.size(w) >= size, F.transform(indices(F.size(w) - (size - 1)), lambda i: shingle(w, i)))
            .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array().cast("array<long>")),
        )
    )


def majority(hashes: np.ndarray) -> int:
    """The 64 majority bits of unsigned hashes; 0 for none."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), VOTE_ROWS):
        part = np.ascontiguousarray(hashes[at : at + VOTE_ROWS], dtype="<i8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("hashes")
        values, ends = hashes.values.to_numpy(zero_copy_only=False), hashes.offsets.to_numpy()
        fps = [majority(values[a:b]) for a, b in itertools.pairwise(ends)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (64 bits as a signed long)."""
    ship_code(docs.sparkSession)
    hashed = docs.select(docs[doc_id].cast("long").alias("doc_id"), shingle_hashes(docs[text]).alias("hashes"))
    return hashed.mapInArrow(_vote, "doc_id long, fp long")


def _flip(value: Column, bit: int) -> Column:
    return value.bitwiseXOR(F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long"))


def short_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that join all fingerprints at one or two bits from each other."""
    ball = F.array(F.col("fp"), *(_flip(F.col("fp"), b) for b in range(64)))
    shared = (
        nodes.select("fp", F.explode(ball).alias("centre"))
        .groupBy("centre")
        .agg(F.collect_list("fp").alias("near"))
        .where(F.size("near") > 1)
    )
    return shared.select(F.explode("near").alias("u"), F.array_min("near").alias("v")).where("u <> v")


def long_links(labelled: DataFrame, segments: tuple = SEGMENTS) -> DataFrame:
    """Links (u, v) between labels, from fingerprints (fp, label) of different labels within the radius."""

    def segment(first: int, bits: int) -> Column:
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    def key(k: int, value: Column) -> Column:
        return value + F.lit(k << 32).cast("long")

    table, probes = [], []
    for k, (first, bits, radius) in enumerate(segments):
        value = segment(first, bits)
        table.append(key(k, value))
        masks = [sum(1 << b for b in flipped) for r in range(radius + 1) for flipped in itertools.combinations(range(bits), r)]
        probes += [key(k, value.bitwiseXOR(F.lit(m).cast("long"))) for m in masks]
    stored = labelled.select(
        F.col("fp").alias("fp2"), F.col("label").alias("label2"), F.explode(F.array(*table)).alias("key")
    )
    asked = labelled.select("fp", "label", F.explode(F.array(*probes)).alias("key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS
    pairs = asked.join(
        stored, (asked["key"] == stored["key"]) & (F.col("fp") < F.col("fp2")) & (F.col("label") != F.col("label2")) & near
    )
    return pairs.select(F.col("label").alias("u"), F.col("label2").alias("v")).distinct()


def _relabelled(nodes: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """``nodes`` with ``column`` replaced by its label, where it has one."""
    renamed = labels.select(F.col("node").alias(column), F.col("label").alias("_new"))
    return nodes.join(renamed, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fp``, ``component_id`` (the smallest id reachable)."""
    marked = cut(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    close = connected(short_links(nodes))
    labelled = cut(_relabelled(nodes.withColumn("label", F.col("fp")), close, "label"), "labelled")
    far = connected(long_links(labelled, SEGMENTS if nodes.count() < MANY else WIDE_SEGMENTS))
    labelled = cut(_relabelled(labelled, far, "label"), "components")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    return marked.join(labelled.join(smallest, "label").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def _wide_sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id`` and its distinct wide shingles; documents without words have none and no row."""
    sets = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.array_distinct(shingle_hashes(docs[text], WIDE_SHINGLE)).alias("hashes"),
    )
    return sets.where(F.size("hashes") > 0)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Rows that repeat an id have a set each."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
    both = by_merge(pairs.join(by_merge(left), "a")).join(by_merge(right), "b")
    common = F.size(F.array_intersect("x", "y"))
    return (
        both.withColumn("common", common)
        .where(100 * F.col("common") >= MIN_SIMILAR * (F.size("x") + F.size("y") - F.col("common")))
        .select("a", "b")
        .distinct()
    )


def wide_components(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``found`` (doc_id, component_id) with components joined that hold documents of similar wide shingles.

    Of each bucket first every member meets the smallest; then the pairs of a bucket that are still in
    different components meet. A large group of near copies is one component by then.
    """
    # Without other columns, whose names could be those used here.
    docs, doc_id, text = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "doc_id", "text"
    labels = cut(
        found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("component_id").alias("label")), "simhash_labels"
    )
    marked = cut(
        minhash.signed(docs, docs[doc_id], docs[text]).where("doc_id IS NOT NULL").withColumn("sig", F.xxhash64("bands")),
        "signed",
    )
    # Rows that repeat an id may have sketches of their own; those ids are never dismissed by one.
    sketches = cut(
        marked.groupBy("doc_id").agg(F.when(F.min("sketch") == F.max("sketch"), F.min("sketch")).alias("sketch")), "sketches"
    )
    # Documents with one signature go on as the smallest of them, each other one with a pair of its own.
    alike = marked.groupBy("sig").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("first"))
    alike = cut(alike, "signatures")
    twins = (
        marked.select("doc_id", "sig").join(alike.select("sig", "first"), "sig").where("doc_id <> first")
        .select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    )
    keyed = alike.select(F.col("first").alias("doc_id"), F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = cut(keyed.join(least, "key"), "wide_buckets")
    stars = buckets.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))

    def near(a: str, b: str) -> Column:
        return F.coalesce(minhash.sketch_distance(F.col(a), F.col(b)) <= FAR, F.lit(True))

    def linked(pairs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
        """``labels`` after the verified ones of those pairs whose labels differ."""
        known = labels.join(sketches, "doc_id")
        of = lambda c: known.select(F.col("doc_id").alias(c), F.col("label").alias(f"label_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        apart = pairs.distinct().join(of("a"), "a").join(of("b"), "b").where("label_a <> label_b")
        apart = cut(apart.where(near("sketch_a", "sketch_b")).drop("sketch_a", "sketch_b"), f"{name}_pairs")
        met = apart.select(F.col("a").alias("_met")).union(apart.select("b")).distinct()
        chosen = docs.join(by_merge(met), docs[doc_id].cast("long") == F.col("_met"), "left_semi")
        sets = cut(_wide_sets(chosen, doc_id, text), f"{name}_sets")
        links = apart.join(_similar(apart.select("a", "b"), sets), ["a", "b"]).select(
            F.col("label_a").alias("u"), F.col("label_b").alias("v")
        )
        return cut(_relabelled(labels, connected(links), "label"), f"{name}_labels")

    labels = linked(stars.unionByName(twins), labels, "stars")
    placed = cut(buckets.select("key", "doc_id").join(labels, "doc_id"), "placed")
    # Every pair of different labels has a side that is not of the leader's label.
    mixed = placed.groupBy("key").agg(
        F.min_by("label", "doc_id").alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    placed = placed.join(mixed.where("low <> high").select("key", "lead"), "key").join(sketches, "doc_id")
    other = placed.select(
        "key", F.col("doc_id").alias("d"), F.col("label").alias("label_d"), F.col("sketch").alias("sketch_d")
    )
    rest = placed.where("label <> lead").join(other, "key").where(
        F.expr("label <> label_d AND (label_d = lead OR doc_id < d)") & near("sketch", "sketch_d")
    )
    labels = linked(
        rest.select(F.least("doc_id", "d").alias("a"), F.greatest("doc_id", "d").alias("b")), labels, "rest"
    )
    joined = labels.select("doc_id", F.col("label").alias("_wide"))
    smallest = labels.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return joined.join(smallest, F.col("_wide") == F.col("label")).select("doc_id", "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the document with the smallest id stays.
    Rows that repeat an id are one document and stay or go together."""
    narrow = cut(simhash_components(docs, doc_id, text).select("doc_id", "component_id"), "narrow")
    nameless = narrow.where("doc_id IS NULL AND component_id IS NULL")
    found = wide_components(docs, narrow, doc_id, text).unionByName(nameless)
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keepers = cut(found.select(F.col("doc_id").alias("_keep")).distinct(), "keepers")
    return docs.join(by_merge(keepers), docs[doc_id].eqNullSafe(keepers["_keep"]), "left_semi")
