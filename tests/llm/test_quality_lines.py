
import time

import pytest
from catalog.compare import connect, differences
from pyspark.sql import functions as F

from tablesync.llm.lines import line_dedup
from tablesync.llm.quality import kept_documents, quality_rules
from tablesync.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
PROSE = " ".join(f"w{i}" for i in range(80))


@pytest.mark.parametrize("name", ["op7_line_frequency", "op9_line_dedup"])
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def judged(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_base_counts_of_odd_texts(spark, documents):
    texts = ["", None, " \t\n", "a b a b a b a", "x#y | z\nx\n\nx\n x", "é " * 60, PROSE, "ab " * 30_000]
    got = judged(quality_rules(documents(spark, texts)))
    counts = [tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))]
    assert counts == [
        (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (7, 7, 0, 0, 7), (6, 8, 2, 1, 0), (60, 60, 0, 0, 60),
        (80, 230, 0, 0, 0), (30_000, 60_000, 0, 0, 30_000),
    ]
    assert [got[i]["base_failed"] for i in range(len(texts))] == [True] * 6 + [False, True]
    assert [got[i]["kept"] for i in range(len(texts))] == [False] * 6 + [True, False]


def test_boilerplate_depletes_but_copies_do_not(spark, documents):
    boiler = " ".join(f"menu{i}" for i in range(60))
    depleted = [(i, f"{boiler}\n{' '.join(f'd{i}x{k}' for k in range(10))}" + "y" * 400, "shop") for i in range(30)]
    copies = [(100 + i, PROSE, "blog") for i in range(30)]
    elsewhere = [(200, f"{boiler}\nown", None)]
    got = judged(quality_rules(documents(spark, depleted + copies + elsewhere)))
    assert {d for d, r in got.items() if not r["kept"]} == set(range(30))
    kept = kept_documents(documents(spark, depleted + copies + elsewhere).selectExpr("*", "1 AS id", "2 AS key", "3 AS kept"))
    assert {r["doc_id"] for r in kept.collect()} == {*range(100, 130), 200} and "key" in kept.columns


def test_boilerplate_that_is_the_longest_line_depletes(spark, documents):
    boiler = " ".join(f"licence{i}" for i in range(60))
    one_line = [(i, f"{boiler}\n{' '.join(f'd{i}x{k}' for k in range(10))}", "shop") for i in range(30)]
    got = judged(quality_rules(documents(spark, one_line)))
    assert not any(r["kept"] for r in got.values())


def test_boilerplate_beside_a_large_group_of_copies_depletes(spark, documents):
    boiler = " ".join(f"menu{i}" for i in range(60))
    pages = [(i, f"{boiler}\n{'y' * 400} d{i}", "shop") for i in range(30)]
    copies = [(100 + i, f"{boiler}\n{PROSE}", "shop") for i in range(60)]
    got = judged(quality_rules(documents(spark, pages + copies)))
    assert {d for d, r in got.items() if r["kept"]} == set(range(100, 160))


def test_quality_of_repeated_rows_nulls_and_none(spark, documents):
    docs = documents(spark, [(1, PROSE), (1, PROSE), (None, PROSE), (None, "few")])
    got = sorted((str(r["doc_id"]), r["kept"]) for r in quality_rules(docs).collect())
    assert got == [("1", True), ("1", True), ("None", False), ("None", True)]
    assert quality_rules(docs.where("false")).count() == 0
    assert kept_documents(docs.where("false")).count() == 0


def test_lines_by_hand(spark, documents):
    long, tail = "A line of more than twenty", "x" * 20
    texts = [
        (1, f"{long}\nown\n{long.upper()} \n"), (2, f"\t{long}\n{tail}"), (3, long), (4, tail), (5, ""), (6, None), (7, "x" * 19),
        (8, "x" * 19), (9, "x" * 19),
    ]
    docs = documents(spark, texts).selectExpr("*", "1 AS id", "2 AS row", "3 AS gone", "4 AS n_lines", "5 AS h1")
    got = {r["doc_id"]: (r["text"] or "", r["n_lines"], r["n_dropped"]) for r in line_dedup(docs).collect()}
    assert got == {
        1: ("own\n", 4, 2), 2: (tail, 2, 1), 3: (long, 1, 0), 4: (tail, 1, 0), 5: ("", 1, 0), 6: ("", 1, 0),
        7: ("x" * 19, 1, 0), 8: ("x" * 19, 1, 0), 9: ("x" * 19, 1, 0),
    }


def test_lines_of_repeated_rows_nulls_long_texts_and_none(spark, documents):
    line = "the same long line everywhere"
    many = "\n".join(f"line number {i} of a very long text" for i in range(20_000))
    docs = documents(spark, [(None, line), (4, line), (4, line), (9, line), (10, many), (11, many), (12, many)])
    got = sorted((str(r["doc_id"]), len(r["text"]), r["n_dropped"]) for r in line_dedup(docs).collect())
    assert got == [
        ("10", 0, 20_000), ("11", 0, 20_000), ("12", len(many), 0), ("4", 0, 1), ("4", 0, 1), ("9", len(line), 0), ("None", 0, 1)
    ]
    assert line_dedup(docs.where("false")).count() == 0


@pytest.mark.parametrize(
    "condition", ["kept", "base_failed", "n_words > 5", "n_repeat_words > 3", "n_dup_lines = 0", "limited_words = 0", "n_symbols > 0"]
)
def test_a_filter_on_any_column_is_as_cheap(spark, condition):
    judged = quality_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    wanted = [r for r in judged.withColumn("_is", F.expr(condition)).collect() if r["_is"]]
    start = time.monotonic()
    assert judged.where(condition).count() == len(wanted)
    assert time.monotonic() - start < 10
