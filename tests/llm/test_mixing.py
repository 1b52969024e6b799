import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tablesync.llm.mixing import flight, mix, mixed_documents
from tablesync.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water filling by hand: source -> target."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        weights = sum(w for s, w in weight.items() if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / weights > 3 * sizes[s]} if weights else set()
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / weights for s in names}
        full |= over


def test_query_by_hand(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    of = Counter()
    for r in rows:
        of[r["source"]] += size[r["doc_id"]]
    wanted = targets(of)
    got = QUERIES["op4_cube_mixture"](spark, SF).collect()
    again = QUERIES["op4_cube_mixture"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    source = {r["doc_id"]: r["source"] for r in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == of[s]
        assert r["target"] == pytest.approx(wanted[s])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in of:
        assert abs(taken[s] - wanted[s]) <= max(0.01 * wanted[s], 5), (s, taken[s], wanted[s], largest[s])


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 2000):
        p, size = rng.random(n), rng.integers(1, 500, n).astype(float)
        out = flight(p, size, rng.random(n))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


def test_inclusion_probabilities():
    """Over many draws each document is taken as often as its probability says."""
    rng = np.random.default_rng(2)
    p, size = np.array([0.2, 0.5, 0.9, 0.4, 0.3, 0.7]), np.array([9.0, 5, 5, 3, 2, 1])
    mean = np.mean([flight(p, size, rng.random(6)) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_many_small_blocks_balance(spark, documents):
    rng = random.Random(3)
    docs = documents(spark, [(i, "w " * rng.randint(1, 40), "ab"[i % 3 == 0]) for i in range(900)])
    for block_rows in (8, 10_000):
        rows = mix(docs, block_rows=block_rows).collect()
        for source in "ab":
            mine = [r for r in rows if r["source"] == source]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 8


def test_odd_rows(spark, documents):
    docs = documents(spark, [(1, "", "a"), (2, None, "a"), (3, "x y", None), (3, "x y", None), (None, "z " * 90, "b"), (2**60 + 1, "q", "c")])
    docs = docs.selectExpr("*", "1 AS size", "2 AS target", "3 AS row", "4 AS copies")
    got = mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([1, 2, 3, 3, None, 2**60 + 1])
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2)) and sum(r["size"] for r in got) == 95
    assert mixed_documents(docs).columns == docs.columns
    assert mix(docs.where("false")).count() == 0 and mixed_documents(docs.where("false")).count() == 0
