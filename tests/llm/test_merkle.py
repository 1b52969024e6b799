"""Proofs and roots against a plain Python tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablesync.llm import merkle
from tablesync.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes):
    """Root, and per leaf the siblings left and right of it at each level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(places):
            first = at // 3 * 3
            paths[leaf].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        places = [at // 3 for at in places]
    return nodes[0], paths


def brute(rows):
    """(doc_id, source, lang, n_chars, text) to the columns of the query."""
    by_source, out = {}, []
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, brute_leaf(row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, over = brute_tree([trees[s][0] for s in sources])
    for k, s in enumerate(sources):
        for (_, _, leaf, row), path in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1]):
            path = path + over[k]
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            fold = brute_leaf((*row[:4], text))
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((row[0], leaf, trees[s][0], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def proofs(df):
    odd = F.crc32(df["doc_id"].cast("string").cast("binary")) % 2 == 0
    leaves = merkle.document_leaves(df, tampered=F.when(odd, F.translate(df["text"], "\n", "")).otherwise(df["text"]))
    done = merkle.verified(merkle.merkle_proofs(leaves), "claim")
    return done.withColumn("proof_sha256", F.sha2(merkle.proof_text(F.col("path")), 256)).select(COLUMNS)


def same(df, rows):
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(brute(rows), key=key)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    same(QUERIES["op12_merkle_manifest"](spark, SF).select(COLUMNS), [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds(spark, monkeypatch, levels):
    """Small blocks: complete and incomplete subtrees in up to five rounds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rnd = random.Random(levels)
    rows = []
    for source, n in [("big", 500), ("a", 1), ("b", 3), ("c", 4), ("d", 28), ("e", 82), ("f", 10), ("é", 9), (None, 55)]:
        rows += [(len(rows) + i, source, None, i, f"line {i}\nend {rnd.random()}") for i in range(n)]
    rnd.shuffle(rows)
    same(proofs(spark.createDataFrame(rows, SCHEMA)), rows)


def test_nulls_ties_repeats_and_odd_texts(spark):
    rows = [
        (None, None, None, None, None),
        (7, "s", "en", 3, "a\nb"),
        (7, "s", "en", 3, "a\nb"),
        (7, "s", "en", 3, "other"),
        (8, "s", None, None, ""),
        (9, "t", "de", 1, "ä" * 100_000 + "\n"),
        (-5, "", "en", 0, "1:a-"),
    ]
    same(proofs(spark.createDataFrame(rows, SCHEMA)), rows)


def test_no_rows(spark):
    assert proofs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, f"s{i % 2}", "en", i, f"t\n{i}") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "leaf", "claim", "at", "path", "root", "subroot", "p", "m", "_over", "value"):
        df = df.withColumn(name, F.lit("x"))
    same(proofs(df), rows)
