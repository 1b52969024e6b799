import hashlib
import random

import pyarrow.parquet as pq

from tablesync.llm import suffixes
from tablesync.llm.queries import QUERIES
from tablesync.llm.suffixes import repeated_substrings

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(id, bytes) -> removed spans and kept bytes, by a table of all 50-byte strings."""
    least = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            key = b[i : i + 50]
            least[key] = min(least.get(key, d), d)
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def got(df):
    return sorted((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    wanted = sorted(
        (d, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for d, n, spans, kept in brute(rows)
    )
    found = QUERIES["op6_suffix_dedup"](spark, SF)
    assert sorted(tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == wanted


def test_random_edits_and_repetition(spark, documents):
    rng = random.Random(5)
    letters = "ab é🙂\n"
    base = "".join(rng.choice(letters) for _ in range(600))
    texts = ["", None, "a" * 49, "a" * 50, "a" * 700, "ab" * 200, base]
    for _ in range(25):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(len(t))] = rng.choice(letters)
        a = rng.randrange(500)
        texts.append("".join(t[a : a + rng.randint(10, 400)]) + rng.choice(["", "a" * 60, base[:80]]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = documents(spark, [(d, t) for d, t in zip(order, texts, strict=True)]).repartition(4)
    docs = docs.selectExpr("*", "1 AS uid", "2 AS id", "3 AS ranges", "4 AS bucket")
    assert got(repeated_substrings(docs)) == sorted(brute([(d, (t or "").encode()) for d, t in zip(order, texts, strict=True)]))


def test_repeated_and_null_ids_and_no_rows(spark, documents):
    x = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(120))
    rows = [(1, x), (1, x), (1, "z" + x), (None, x[:60]), (2, x)]
    found = repeated_substrings(documents(spark, rows)).collect()
    result = sorted((str(r["doc_id"]), bytes(r["kept"]).decode()) for r in found)
    assert result == sorted([("1", x[60:]), ("1", x[60:]), ("1", "z" + x[60:]), ("None", x[:60]), ("2", "")])
    assert repeated_substrings(documents(spark, ["a"]).where("false")).count() == 0


def test_a_stock_phrase_in_very_many_contexts_is_split(spark, documents, monkeypatch):
    """One string in 20,000 contexts, some shared: no group of an anchor is larger than the limit."""
    monkeypatch.setattr(suffixes, "HOT", 200)
    sizes = []
    monkeypatch.setattr(suffixes, "_by_suffix", lambda known, runs, plain=suffixes._by_suffix: (sizes.append(runs.count()), plain(known, runs))[1])
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choices(letters, k=n))
    heads, tails = [word(40) for _ in range(150)], [word(40) for _ in range(150)]
    texts = [rng.choice(heads)[rng.randrange(30) :] + " all rights reserved! " + rng.choice(tails)[: rng.randrange(10, 40)] for _ in range(20_000)]
    docs = documents(spark, texts).repartition(4)
    assert got(repeated_substrings(docs)) == sorted(brute([(d, t.encode()) for d, t in enumerate(texts)]))
    assert sizes and sizes[0] > 200


def test_every_anchor_split_gives_the_same(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 0)
    rows = [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    docs = documents(spark, rows)
    assert got(repeated_substrings(docs)) == sorted(brute([(d, t.encode()) for d, t in rows]))
