import hashlib

import pyarrow.parquet as pq
import sentencepiece

from tablesync.llm import pieces
from tablesync.llm.pieces import MODEL, Fold, decode, encode, encode_units, first_byte, piece_table
from tablesync.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = [
    "", None, " ", "   ", "\n", "hello  world", " lead", "trail ", "a\nb\tc", "ﬁ ① é é", "​\x00z",
    "日本語 \U0001f642\U0001f9ff", "x" * 3000, "naïve " * 500, "</s><s>[INST]", "aaaaabaaaab" * 40, "ß" * 25,
]


def test_ids_equal_the_library_and_decode(spark, documents):
    docs = documents(spark, TEXTS)
    for units in (0, 1, 1000):
        got = decode(encode(docs, dictionary_units=units)).orderBy("doc_id").collect()
        assert [list(r["ids"]) for r in got] == [LIBRARY.encode(t or "") for t in TEXTS]
        assert [r["decoded"] for r in got] == [t or "" for t in TEXTS]


def test_lattice_of_every_unit(spark):
    text = pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:20]
    units = sorted({"▁" + w for t in text for w in t.split(" ") if w})
    units += ["▁▁▁▁▁x", "▁\U0001f9ff\U0001f9ff", "▁" * 21]
    found = encode_units(spark.createDataFrame([(u,) for u in units], "unit string")).collect()
    assert len(found) == len(set(units))
    for r in found:
        assert list(r["ids"]) == LIBRARY.encode(r["unit"][1:].replace("▁", " ")), r["unit"]


def test_query_round_trip(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = QUERIES["op8_sentencepiece"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r["doc_id"]])
        assert (r["n_ids"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), digest(",".join(map(str, ids))), digest(texts[r["doc_id"]])
        )


def test_no_rows_and_clashing_columns(spark, documents):
    none = documents(spark, ["a"]).where("false")
    assert encode(none).count() == 0
    more = documents(spark, ["a b", None]).selectExpr("*", "'x' AS ids", "1 AS unit", "2 AS piece")
    got = decode(encode(more)).orderBy("doc_id").collect()
    assert [r["decoded"] for r in got] == ["a b", ""] and got[0]["unit"] == 1


def test_workers_hold_little(spark, documents, monkeypatch):
    """Whole texts come in small Arrow batches, and a worker keeps its dictionary with a bounded cache on top."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = documents(spark, [f"a b{i}" for i in range(3000)])
        assert [list(r["ids"]) for r in encode(docs).orderBy("doc_id").collect()] == [LIBRARY.encode(f"a b{i}") for i in range(3000)]
        assert int(spark.conf.get(name)) <= 1024
    finally:
        spark.conf.set(name, before)
    monkeypatch.setattr(pieces, "TASK_CACHE", 10)
    known = {"▁known": b"1234"}
    fold = Fold(known, {p: (rank, i) for p, i, rank in piece_table()}, first_byte())
    for i in range(50):
        assert list(memoryview(fold[f"▁w{i}"]).cast("i")) == LIBRARY.encode(f"w{i}")
        assert len(fold) <= 11 and fold["▁known"] == b"1234"
    assert not any(d == known for d in vars(fold).values())
