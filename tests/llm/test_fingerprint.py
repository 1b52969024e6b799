import hashlib
import re
import struct

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from tablesync.llm.fingerprint import edited_documents, likeness, with_fingerprint
from tablesync.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chain(*values):
    """XXH64 of each value, seeded by the one before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed=seed)
    return seed


def signed(h):
    return struct.pack("<Q", h)


def brute(text):
    words = [w.encode() for w in WORD.findall(text)]
    grams = [chain(*words[i : i + 5]) for i in range(len(words) - 4)]
    if words and not grams:
        grams = [chain(b" ".join(words))]
    seen, bins = {}, {}
    for place, g in enumerate(grams):
        rank = chain(signed(g), struct.pack("<i", seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
        bins.setdefault(rank & 63, []).append((rank - 2**64 if rank >> 63 else rank, place))
    out = []
    for b, items in sorted(bins.items()):
        picked = sorted(sorted(items)[:2], key=lambda x: x[1])
        h = chain(*(struct.pack("<q", r) for r, _ in picked))
        out.append(((h >> 38) & (2**26 - 1)) * 64 + b - 2**31)
    return out


def like(a, b):
    bins = {x & 63 for x in a} | {x & 63 for x in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


def hexed(a):
    return "".join(f"{x & 0xFFFFFFFF:08x}" for x in a)


def expected(rows):
    out = []
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, new = brute(t), brute(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((d, len(t), digest, hexed(own), hexed(new), like(own, new), like(own, brute(after))))
    return out


def test_query_equals_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist())
    got = [tuple(r) for r in QUERIES["op2_order_minhash"](spark, SF).orderBy("doc_id").collect()]
    assert got == expected(rows)
    assert sum(g[5] for g in got) > 3 * sum(g[6] for g in got)


def test_odd_texts(spark, documents):
    texts = ["", None, " \n", "one", "a b c d", "x y " * 4000, "É ﬁ 🙂 \t z é", "the same words " * 3, "the same words " * 3]
    docs = documents(spark, [(7 * i, t) for i, t in enumerate(texts)]).selectExpr("*", "1 AS row", "2 AS print", "3 AS n")
    both = with_fingerprint(edited_documents(docs), "edited", "edited_print").orderBy("doc_id").collect()
    wanted = expected([(7 * i, t or "") for i, t in enumerate(texts)])
    got = [(r["doc_id"], r["n_chars"], hexed(r["print"]), hexed(r["edited_print"])) for r in both]
    assert got == [(w[0], w[1], w[3], w[4]) for w in wanted]


def test_order_matters_beyond_words(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    texts = [" ".join(words), " ".join(moved), " ".join(reversed(words))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    a, b, c = (r["p"] for r in with_fingerprint(df, "text", "p").collect())
    assert like(a, a) == 1 and like(a, c) == 0 and 0.2 < like(a, b) < 0.9


def test_repeated_null_and_no_rows(spark, documents):
    assert edited_documents(documents(spark, ["a"]).where("false")).count() == 0
    docs = documents(spark, [(1, "aa bb"), (1, "aa bb"), (None, "cc dd"), (1, "ee ff")])
    got = edited_documents(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "None"]
    single = edited_documents(documents(spark, ["abcd"])).collect()
    assert [(r["edited"]) for r in single] == ["abab"]
    empty = F.array().cast("array<int>")
    one = spark.range(1).select(likeness(empty, F.array(F.lit(1))).alias("x"), likeness(empty, empty).alias("y"))
    assert tuple(one.first()) == (0, 1)
