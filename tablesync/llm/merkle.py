"""Merkle manifest of a table: every row a leaf, a tree per source, and one tree over the sources' roots.

A digest is the lowercase hex SHA-256 of its inputs, joined; digests go in as hex text. ``FANOUT`` consecutive
nodes become one, the last run may have fewer, even one, and this repeats while more than one node remains.

Method: a butterfly exchange. Leaves are numbered in their tree (a distributed prefix sum, so that a source with
a third of all rows is no task's burden) and packed into aligned blocks of ``FANOUT ** LEVELS``. A block computes
its own subtree. Then, round by round, aligned groups of blocks swap their current roots: block p meets the
blocks at its own offset in the sibling subtrees, at most ``FANOUT`` of them, hashes their roots to the parent,
and notes the siblings. All blocks of a subtree do the same hashing redundantly, so that after the last round
each has the root and its own upper proof, and nothing is passed downward. In an incomplete last subtree the
blocks present also take the seats of the missing ones. The only tables beside the leaves have a row per block.

Defined results: NULL fields count as ``-``. Leaves ascend by key (NULL first), rows that repeat a key by digest;
equal rows are equal leaves with a proof each. A NULL source is a source of its own and comes first. A table
without rows has no leaves and no root. Columns beside those of the leaf are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import cut
from tablesync.operators.running import number_rows

FANOUT = 3
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Each field by its UTF-8 byte count and value, so that no two rows share a spelling."""

    def spelled(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(spelled, fields))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _power(exponent: Column) -> Column:
    return F.get(F.array(*(F.lit(FANOUT**k) for k in range(LEVELS + 1))), exponent)


def _levels(leaves: Column, depth: Column) -> Column:
    """The nodes of each level of a block, leaves first."""

    def parents(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
        return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FANOUT + 1, FANOUT), ""), 256))

    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps, F.array(leaves), lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1))))
    )


def _path(levels: Column, at: Column, depth: Column) -> Column:
    """Siblings of a block's leaf up to the block's root."""

    def siblings(k: Column) -> Column:
        nodes, node = F.get(levels, k), F.floor(at / _power(k)).cast("int")
        first = node - node % FANOUT
        left, right = F.slice(nodes, first + 1, node - first), F.slice(nodes, node + 2, first + FANOUT - 1 - node)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    steps = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, siblings)


def _exchange(blocks: DataFrame, step: int) -> DataFrame:
    """One round: blocks (tree, m, p, node, path) whose nodes span ``step`` blocks each to their parents."""
    subtree = F.floor(F.col("p") / step)
    seat, present = F.col("p") % step, F.least(F.lit(step), F.col("m") - F.col("t") * step)
    alone = F.col("t") % FANOUT == 0
    # Seats of absent blocks in the last subtree are taken by those present, if siblings ask for them.
    seats = F.when(
        ~alone & (seat + present < step), F.concat(F.array(seat), F.sequence(seat + present, F.lit(step - 1), present))
    ).otherwise(F.array(seat))
    sent = blocks.withColumn("t", subtree).select("*", F.floor(F.col("t") / FANOUT).alias("g"), F.explode(seats).alias("seat"))
    own = F.col("seat") == seat
    member = F.struct("t", "node", own.alias("own"), "p", "m", F.when(own, F.col("path")).alias("path"))
    met = sent.groupBy("tree", "g", "seat").agg(F.array_sort(F.collect_list(member)).alias("met"))
    each = met.select("tree", "met", F.explode(F.filter("met", lambda x: x["own"])).alias("me"))

    def nodes(keep) -> Column:
        return F.array_join(F.transform(F.filter("met", keep), lambda x: x["node"]), "")

    left, right = nodes(lambda x: x["t"] < F.col("me.t")), nodes(lambda x: x["t"] > F.col("me.t"))
    going = F.col("me.m") > step
    grown = F.concat("me.path", F.array(F.struct(left.alias("left"), right.alias("right"))))
    return each.select(
        "tree",
        F.col("me.m").alias("m"),
        F.col("me.p").alias("p"),
        F.when(going, F.sha2(nodes(lambda x: F.lit(True)), 256)).otherwise(F.col("me.node")).alias("node"),
        F.when(going, grown).otherwise(F.col("me.path")).alias("path"),
    )


def climbed(nodes: DataFrame, order: Sequence[Column | str], leaf: str = "leaf") -> DataFrame:
    """``nodes`` (``tree``, ``leaf`` and more) with ``path`` to the root of their tree, and that ``root``."""
    given = [c for c in nodes.columns if c != "tree"]
    placed = number_rows(nodes, ["tree"], order, "at")
    size = FANOUT**LEVELS
    packed = cut(
        placed.groupBy("tree", F.floor(F.col("at") / size).alias("p"))
        .agg(F.array_sort(F.collect_list(F.struct("at", *given))).alias("items")),
        "merkle_blocks",
    )
    trees = packed.groupBy("tree").agg((F.max("p") + 1).alias("m"), F.sum(F.size("items")).alias("n"))
    # A tree of one block ends where one node is left; other blocks climb all their levels.
    short = F.size(F.filter(F.array(*(F.lit(FANOUT**k) for k in range(LEVELS))), lambda s: s < F.col("n")))
    depth = F.when(F.col("m") == 1, short).otherwise(F.lit(LEVELS))
    blocks = packed.join(trees, "tree").withColumn("depth", depth)
    leaves = F.transform("items", lambda x: x[leaf])
    top = F.element_at(F.element_at(_levels(leaves, F.col("depth")), -1), 1)
    state = cut(
        blocks.select("tree", "m", "p", top.alias("node"), F.array().cast(PATH).alias("path")), "merkle_roots"
    )
    most = state.agg(F.max("m")).first()[0] or 0
    alone, several, step = state.where("m = 1"), state.where("m > 1"), 1
    while step < most:
        several, step = _exchange(several, step), step * FANOUT
    upper = alone.unionByName(several).select("tree", "p", F.col("node").alias("root"), F.col("path").alias("upper"))
    # Levels stand in a one-row array, so that they are computed once a block and not once a leaf.
    proved = F.flatten(
        F.transform(
            F.array(_levels(leaves, F.col("depth"))),
            lambda levels: F.transform(
                "items",
                lambda x: F.struct(
                    *(x[c].alias(c) for c in given),
                    F.concat(_path(levels, (x["at"] % size).cast("int"), F.col("depth")), F.col("upper")).alias("path"),
                ),
            ),
        )
    )
    return blocks.join(upper, ["tree", "p"]).select("tree", "root", F.explode(proved).alias("x")).select("tree", "root", "x.*")


def merkle_proofs(leaves: DataFrame, tree: str = "source", key: str = "doc_id") -> DataFrame:
    """``leaves`` (key, source, ``leaf``, more) with ``subroot``, ``root`` and the whole ``path`` to the root."""
    plain = leaves.select(F.struct(F.col(tree).alias("value")).alias("tree"), *(F.col(c) for c in leaves.columns if c != tree))
    lower = climbed(plain, [key, "leaf"])
    lower = cut(lower.withColumnRenamed("root", "subroot"), "merkle_lower")
    subroots = lower.groupBy("tree").agg(F.min("subroot").alias("leaf"))
    over = climbed(
        subroots.select(F.struct(F.lit(0).alias("value")).alias("tree"), F.col("tree").alias("under"), "leaf"), ["under"]
    ).select(F.col("under").alias("tree"), "root", F.col("path").alias("_over"))
    return lower.join(over, "tree").select(
        F.col("tree.value").alias(tree),
        *(c for c in leaves.columns if c != tree),
        "subroot",
        "root",
        F.concat("path", "_over").alias("path"),
    )


def document_leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, text: str = "text", tampered: Column | None = None) -> DataFrame:
    """Leaves of ``docs``: key, source, ``leaf``; with ``tampered`` also ``claim``, the digest of the row as it
    would be with that text."""
    found = {"leaf": leaf_digest([docs[c] for c in fields])}
    if tampered is not None:
        found["claim"] = leaf_digest([tampered if c == text else docs[c] for c in fields])
    # Stored, because numbering samples its input first and would read every text twice.
    return cut(docs.select(docs[fields[0]], docs[fields[1]], *(v.alias(k) for k, v in found.items())), "merkle_leaves")


def verified(proofs: DataFrame, claim: str = "leaf") -> DataFrame:
    """``proofs`` with ``folded_root`` recomputed from ``claim``, and whether it equals the root."""
    again = folded(F.col(claim), F.col("path"))
    return proofs.withColumn("folded_root", again).withColumn("verified", F.col("folded_root") == F.col("root"))
