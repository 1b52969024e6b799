"""The trie against a plain Python one, over rebuilt and given conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablesync.llm import trie
from tablesync.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    """Turns (role, text) per id; ties of turn must not occur."""
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in given.items()}


def rebuild(given):
    out = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = int(c / 5) * 5
        out[c] = given.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [sums[k] for k in children[node]]
        sums[node] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    ends = lambda n: ",".join(map(str, sorted(c for c in members[n] if len(convs[c]) == len(n))))
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *sums[n],
         hashlib.sha256(ends(n).encode()).hexdigest())
        for n, m in members.items()
    )


def got(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=lambda r: (r[0], r[1]))


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(QUERIES["op13_prefix_trie"](spark, SF)) == brute(rebuild(conversations(map(tuple, rows))))


def random_rows(seed, n, turns):
    rnd, rows = random.Random(seed), []
    for c in range(-n // 4, n):
        for t in range(rnd.randrange(turns)):
            text = rnd.choice(["", "a", "ä", "bb"]) if rnd.random() < 0.6 else f"{c} {t}"
            rows.append((c * rnd.choice([1, 1, 3]) * 1000 + c, t, rnd.choice(["user", None, "user", "user"]), text))
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize(("seed", "cells"), [(1, None), (2, None), (3, 1 << 15)])
def test_random(spark, monkeypatch, seed, cells):
    """Also with a sketch far too small, where the exact grouping has all the work."""
    rows = random_rows(seed, 120, 6)
    if cells:
        monkeypatch.setattr(trie, "estimate", lambda pages, cells: F.lit(2))
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.prefix_trie(*trie.rebuilt(trie.digested(df)))) == brute(rebuild(conversations(rows)))
    assert got(trie.conversation_trie(df)) == brute(conversations(rows))


def test_one_conversation_that_all_copy_and_long_ones(spark):
    """A hot copied conversation, a long pair, and paths that hang on each other."""
    rows = [(c, t, "user", f"copy {t}") for c in range(0, 1400, 2) for t in range(3)]
    rows += [(c, t, "user", f"long {min(t, 398 + c % 2)}") for c in (3001, 3002) for t in range(400)]
    rows += [(5000 + k, t, "user", f"s {t}" if t <= k else f"own {k} {t}") for k in range(1, 30) for t in range(k + 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.conversation_trie(df)) == brute(conversations(rows))


def test_nulls_turnless_and_clashing_columns(spark):
    rows = [
        (None, 0, "user", "nobody"),
        (7, None, None, None),
        (7, 0, "user", "x"),
        (2**62, 3, "user", "far"),
        (-3, 1, "assistant", ""),
        (6, 5, "user", "alone"),
        (12, 0, "user", "p"),
        (13, 0, "user", "p"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("c", "d", "i", "h1", "s1", "last", "bytes", "n"):
        df = df.withColumn(name, F.lit("x"))
    assert got(trie.prefix_trie(*trie.rebuilt(trie.digested(df)))) == brute(rebuild(conversations(rows)))


def test_repeated_turns_have_a_defined_place(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "a")]
    found = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).where("depth = 3").collect()
    assert [(r.conv_id, r.n_convs) for r in found] == [(1, 2)]


def test_no_rows(spark):
    assert trie.prefix_trie(*trie.rebuilt(trie.digested(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_screen_proves_only_singletons(spark):
    rows = random_rows(5, 200, 6)
    found = trie.prefixes(trie.rebuilt(trie.digested(spark.createDataFrame(rows, SCHEMA)))[0])
    shared, tails = trie.screened(found)
    keys = ["d", *trie.SUMS]
    assert tails.join(found.groupBy(keys).count().where("count > 1"), keys).isEmpty()
    assert tails.count() + shared.count() == found.count()
    # Nearly every singleton is proven.
    single = found.groupBy(keys).count().where("count = 1").count()
    assert tails.count() > 0.9 * single
