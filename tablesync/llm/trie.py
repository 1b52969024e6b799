"""Trie of conversation prefixes, screened by a count-min sketch.

Every distinct sequence of first turns is a node. A prefix is known by its depth and a 128-bit digest, a sum of
hashes of (place, role, text), so that a conversation of any length is digested by a distributed prefix sum.

* Screening: a count-min sketch of all prefix digests, ``ROWS`` rows of 2-bit counters that stop at two. Its size
  follows the number of prefixes up to ``MAX_CELLS`` a row (24 MB in all), which bounds what is broadcast. An
  estimate is never too low, so one proves that a single conversation has the prefix, and then all that follow.
  Those tails become nodes where they are, without a shuffle. Beyond the bound more prefixes pass the screen; they
  are grouped exactly like the shared ones, and the result is the same.
* Grouping: prefixes that may be shared are grouped by depth and digest, combined before they move.
* A node is named by its smallest member and its depth. Nodes with one smallest member are a path, and paths form
  a tree. Sums over subtrees are sums over paths, carried up that tree by pointer doubling (rounds grow with the
  logarithm of its height), then a prefix sum along each path.
* Ids that end at one node are joined in numbered pieces and hashed as a stream, however many they are.

Defined results: turns are ordered by ``turn``, NULL first, ties by a digest of role and text. NULL role or text
is empty. Rows without a conv_id belong to no conversation. No rows, no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import cut, ship_code, whole
from tablesync.operators.running import number_rows, running_totals

ROWS = 3
MAX_CELLS = 1 << 25
COUNTERS = 32  # in a word of the sketch
PAGE = 1024  # words
PIECE = 512  # ids
SUMS = ("s1", "s2", "s3", "s4")
HASHES = ("v1", "v2", "v3", "v4")
SHARED = 5  # conversations that take their head from the same one
HEADS = 9


def digested(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns without their texts: ``c``, place ``i`` from 0, two digests of role and text, bytes of the text."""
    role_, text_ = whole(rows[role]), whole(rows[text])
    small = rows.where(rows[conv].isNotNull()).select(
        rows[conv].cast("long").alias("c"),
        rows[turn].alias("turn"),
        F.xxhash64(role_, text_).alias("h1"),
        F.xxhash64(F.lit(1), text_, role_).alias("h2"),
        F.octet_length(text_).cast("long").alias("bytes"),
    )
    return cut(number_rows(small, ["c"], ["turn", "h1", "h2"], "i").drop("turn"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns come from conversation c - c % 5, with h = crc32(c) % 9.

    Gives the turns (c, d from 1, h1, h2, bytes, last) and the conversations (c, n), n their new length.
    """
    base = F.col("c") - F.col("c") % SHARED
    head = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    own = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n_own")).withColumns({"b": base, "h": head})
    given = own.select(F.col("c").alias("b"), F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = cut(
        own.join(given, "b", "left").select(
            "c", "b", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n")
        ),
        "conversations",
    )
    heads = convs.join(
        turns.where(F.col("i") < HEADS - 1).withColumnRenamed("c", "b"), "b"
    ).where("i < h").select("c", (F.col("i") + 1).alias("d"), "h1", "h2", "bytes", "n")
    rest = turns.join(convs, "c").where("i >= h").select(
        "c", (F.col("i") - F.col("h") + F.col("taken") + 1).alias("d"), "h1", "h2", "bytes", "n"
    )
    return heads.unionByName(rest).withColumn("last", F.col("d") == F.col("n")).drop("n"), convs.select("c", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (c, d, h1, h2, bytes, last) with the digest of the prefix that each ends (``SUMS``) and of the
    one before (``p1`` to ``p4``)."""
    k1, k2 = F.xxhash64("d", "h1", "h2"), F.xxhash64("h2", "h1", "d")
    # Halves of the hashes: sums of as many as 2**31 turns stay exact.
    halves = [x for k in (k1, k2) for x in (k.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(k, 32))]
    keyed = turns.select("c", "d", "bytes", "last", *(v.alias(n) for v, n in zip(halves, HASHES, strict=True)))
    summed = running_totals(keyed, ["c"], ["d"], {s: F.col(v) for s, v in zip(SUMS, HASHES, strict=True)})
    before = [(F.col(s) - F.col(v)).alias(f"p{i}") for i, (s, v) in enumerate(zip(SUMS, HASHES, strict=True), 1)]
    return cut(summed.select("c", "d", "bytes", "last", *SUMS, *before), "prefixes")


def _cell(row: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(row), "d", *SUMS), F.lit(cells))


def sketch(found: DataFrame, cells: int) -> Column:
    """The count-min sketch as one value: pages of words, the rows of the sketch one after another."""
    words = cells // COUNTERS
    counted = (
        found.select(F.explode(F.array(*(_cell(r, cells) + r * cells for r in range(ROWS)))).alias("cell"))
        .groupBy("cell")
        .agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("n"))
    )
    # Each cell once: adding is setting its two bits.
    held = counted.select(
        F.floor(F.col("cell") / COUNTERS).alias("word"),
        F.call_function("shiftleft", F.col("n"), (2 * (F.col("cell") % COUNTERS)).cast("int")).alias("bits"),
    ).unionByName(found.sparkSession.range(ROWS * words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    pages = (
        held.groupBy("word").agg(F.bit_or("bits").alias("bits"))
        .groupBy(F.floor(F.col("word") / PAGE).alias("page"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bits"))
    )
    one = pages.agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "bits"))), lambda p: p["bits"]).alias("sketch"))
    return one.scalar()


def estimate(pages: Column, cells: int) -> Column:
    """Smallest of a prefix's counters: 1 is proof of a single conversation, 2 says two or more."""

    def counter(row: int) -> Column:
        cell = _cell(row, cells) + row * cells
        word = F.floor(cell / COUNTERS)
        bits = F.get(F.get(pages, F.floor(word / PAGE).cast("int")), (word % PAGE).cast("int"))
        return F.call_function("shiftright", bits, (2 * (cell % COUNTERS)).cast("int")).bitwiseAND(F.lit(3).cast("long"))

    return F.least(*map(counter, range(ROWS)))


def cells_for(n: int) -> int:
    """A power of two, four cells to a prefix or more, up to the bound."""
    return min(max(1 << (4 * n - 1).bit_length(), COUNTERS * PAGE), MAX_CELLS)


def screened(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes that may be shared, and proven tails with ``first``, the depth where the conversation's tail begins."""
    cells = cells_for(max(found.count(), 1))
    proven = found.where(estimate(sketch(found, cells), cells) == 1)
    firsts = cut(proven.groupBy("c").agg(F.min("d").alias("first")), "first_single")
    marked = found.join(firsts, "c", "left")
    return marked.where(F.col("first").isNull() | (F.col("d") < F.col("first"))), marked.where("d >= first")


def shared_nodes(shared: DataFrame, convs: DataFrame) -> DataFrame:
    """Exact groups of the prefixes that may be shared, and the root."""
    before = [f"p{i}" for i in range(1, 5)]
    grouped = shared.groupBy("d", *SUMS).agg(
        F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("bytes").alias("bytes"),
        *(F.min(p).alias(p) for p in before),
        F.count_if("last").alias("n_ends"),
        F.min(F.when(F.col("last"), F.col("c"))).alias("one_end"),
    )
    ended = F.col("n") == 0
    root = convs.agg(
        F.min("c").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(ended).alias("n_ends"),
        F.min(F.when(ended, F.col("c"))).alias("one_end"),
    ).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = root.select(
        "*", zero.alias("d"), zero.alias("bytes"), *(zero.alias(s) for s in SUMS), *(F.lit(None).cast("long").alias(p) for p in before)
    )
    return cut(grouped.unionByName(top), "nodes")


def _named(rows: DataFrame, nodes: DataFrame, root: int | None) -> DataFrame:
    """``rows`` (d, p1..p4, ...) with ``parent_conv_id``. Rows under the root, often most, need no join."""
    names = nodes.select((F.col("d") + 1).alias("d"), *(F.col(s).alias(f"p{i}") for i, s in enumerate(SUMS, 1)), F.col("conv_id").alias("parent_conv_id"))
    top = rows.where("d = 1").withColumn("parent_conv_id", F.lit(root).cast("long"))
    return rows.where("d > 1").join(names, ["d", "p1", "p2", "p3", "p4"]).unionByName(top)


def path_totals(paths: DataFrame, values: list[str]) -> DataFrame:
    """``paths`` (x, jump: the path it hangs on, values) with the values summed over the path and all below it.

    Doubling: after k rounds a sum covers what is less than 2**k links below, and ``jump`` is as many links up.
    """
    state = cut(paths.select("x", "jump", *values), "paths")
    while not state.where(F.col("jump").isNotNull()).isEmpty():
        below = state.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("x")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        further = state.select(F.col("x").alias("jump"), F.col("jump").alias("_jump"))
        joined = state.join(below, "x", "left").join(further, "jump", "left")
        state = cut(
            joined.select("x", F.col("_jump").alias("jump"), *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)),
            "paths",
        )
    return state.drop("jump")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order and are never held together."""
    key, state, out = None, None, []
    for batch in batches:
        for conv, d, ids in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "d", "ids")), strict=True):
            if (conv, d) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (conv, d), hashlib.sha256()
                state.update(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _ends(out)
        out = []
    if key is not None:
        yield _ends([(*key, state.hexdigest())])


def _ends(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "d", "ends"])


def ends_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids ``c`` of each node (conv_id, d), joined by commas."""
    ship_code(members.sparkSession)
    placed = number_rows(members, ["conv_id", "d"], ["c"], "at")
    pieces = placed.groupBy("conv_id", "d", F.floor(F.col("at") / PIECE).alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids")
    )
    ordered = pieces.repartition("conv_id", "d").sortWithinPartitions("conv_id", "d", "piece")
    return ordered.select("conv_id", "d", "ids").mapInArrow(_stream, "conv_id long, d long, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (c, d, h1, h2, bytes, last), conversations in ``convs`` (c, n)."""
    shared, tails = screened(prefixes(turns))
    nodes = shared_nodes(shared, convs)
    found = nodes.where("d = 0").select("conv_id").first()
    root = found[0] if found else None
    before = [f"p{i}" for i in range(1, 5)]
    tops = cut(_named(tails.where("d = first").select("c", "d", "last", *before), nodes, root), "tail_tops")

    # Children by the parent's name: nodes and whole tails alike.
    named = cut(
        _named(nodes.where("d > 0"), nodes, root).unionByName(
            nodes.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
        ),
        "named_nodes",
    )
    up = [F.col("parent_conv_id").alias("conv_id"), (F.col("d") - 1).alias("d")]
    children = named.where("d > 0").select(*up, F.lit(0).alias("tail")).unionByName(tops.select(*up, F.lit(1).alias("tail")))
    counts = children.groupBy("conv_id", "d").agg(F.count(F.lit(1)).alias("n_children"), F.sum("tail").alias("n_tails"))
    family = named.join(counts, ["conv_id", "d"], "left").fillna(0, ["n_children", "n_tails"])
    family = cut(
        family.withColumn("leaves", F.col("n_tails") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn(
            "saved", (F.col("n_convs") - 1) * F.col("bytes")
        ).drop("n_tails"),
        "family",
    )

    sums = ["leaves", "saved"]
    paths = family.groupBy(F.col("conv_id").alias("x")).agg(
        F.min("d").alias("top"), F.min_by("parent_conv_id", "d").alias("jump"), *(F.sum(v).alias(v) for v in sums)
    )
    paths = cut(paths, "path_tops")
    totals = path_totals(paths, sums)
    hung = (
        paths.where(F.col("jump").isNotNull()).select("x", F.col("jump").alias("conv_id"), (F.col("top") - 1).alias("d"))
        .join(totals, "x").groupBy("conv_id", "d").agg(*(F.sum(v).alias(f"_{v}") for v in sums))
    )
    with_hung = family.join(hung, ["conv_id", "d"], "left")
    below = running_totals(
        with_hung,
        ["conv_id"],
        [F.col("d").desc()],
        {f"sum_{v}": F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in sums},
    )

    keys = ["d", *SUMS]
    several = shared.where("last").join(nodes.where("n_ends > 1 AND d > 0").select(*keys, "conv_id"), keys)
    turnless = convs.where("n = 0").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("d"), "c")
    ends = ends_digests(several.select("conv_id", "d", "c").unionByName(turnless))
    none = F.sha2(F.lit(""), 256)
    own_end = F.when(F.col("n_ends") == 0, none).when(F.col("n_ends") == 1, F.sha2(F.col("one_end").cast("string"), 256))
    shared_rows = below.join(ends, ["conv_id", "d"], "left").select(
        "conv_id",
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"),
        F.coalesce(own_end, "ends").alias("ends_sha256"),
    )
    inner = tails.where("d > first").select("c", "d", "last", F.col("c").alias("parent_conv_id"))
    tail_rows = inner.unionByName(tops.select("c", "d", "last", "parent_conv_id")).select(
        F.col("c").alias("conv_id"),
        F.col("d").alias("depth"),
        "parent_conv_id",
        F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return shared_rows.unionByName(tail_rows)


def conversation_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations in ``rows`` as they are."""
    turns = digested(rows, conv, turn, role, text)
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    given = turns.join(convs, "c").select("c", (F.col("i") + 1).alias("d"), "h1", "h2", "bytes", (F.col("i") + 1 == F.col("n")).alias("last"))
    return prefix_trie(given, convs)
