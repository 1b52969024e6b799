"""Language identification: exact sums, held-out accuracy, codes, and what the operator must bear."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablesync.llm import langid
from tablesync.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {
    "aa": "ka ki ku ta ti tu na ni",
    "bb": "sch ung ein cht ber ich aus zu",
    "cc": "oi eau ou é è que ment tion",
    "dd": "при ст ов на ние ко",
    "ee": "los ado ción es ar que dad",
    "ff": "wh th ing ea ou nd er",
    "gg": "szy czy prz ów ska nie",
    "hh": "αι ος ου τη κα νο",
    "ii": "ään yys kko ssa lla tta",
}


def made(n, languages, seed=0, label=None):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        lang = languages[i % len(languages)]
        parts = SYLLABLES[lang].split()
        words = ["".join(rnd.choices(parts, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(12, 60))]
        rows.append((i, " ".join(words).capitalize(), lang if label is None else label))
    return rows


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in tested]) > 0.98


@pytest.mark.parametrize("languages", [2, 4, 9])
def test_accuracy_by_number_of_languages(spark, languages):
    names = sorted(SYLLABLES)[:languages]
    rows = made(60 * languages, names, languages)
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows if held_out(i)]
    assert np.mean(right) > 0.97 and not any(got[i]["ambiguous"] for i, _, lang in rows if got[i]["lang_pred"] != lang)


def test_labels_of_held_out_documents_are_not_used(spark):
    rows = made(200, ["aa", "bb", "cc"], 3)
    swapped = [(i, t, "zz" if held_out(i) else lang) for i, t, lang in rows]
    one, two = (sorted(map(tuple, langid.language_id(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, swapped))
    assert one == two


def test_mixed_text_is_ambiguous(spark):
    rows = made(300, ["aa", "ff"], 4)
    half = {r[2]: r[1] for r in rows[:2]}
    rows.append((10_000_000, " ".join([half["aa"][:60], half["ff"][:60]] * 3), None))
    rows.append((10_000_001, "q", None))
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[10_000_001]["ambiguous"] and np.mean([got[r[0]]["ambiguous"] for r in rows[:300]]) < 0.05


def test_nulls_empty_long_repeats_and_clashing_columns(spark):
    rows = made(120, ["aa", "bb"], 5)
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 34 !?", "bb"), (None, rows[0][1], "aa"), (504, rows[1][1], None)]
    rows += [rows[3], rows[3], (505, "ka ki ku " * 200_000, None), (506, "你好", "aa")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("label", "letter", "quarter", "margins", "letters", "score", "held_out", "source"):
        df = df.withColumn(name, F.lit("x"))
    got = langid.language_id(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i in (500, 501, 502):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert by_id[None]["lang_pred"] == "aa" and by_id[None]["held_out"] is False
    assert by_id[504]["lang_pred"] == "bb" and by_id[505]["lang_pred"] == "aa"
    assert sum(r["doc_id"] == rows[3][0] for r in got) == 3
    assert by_id[506]["lang_pred"] in ("aa", "bb")


def test_few_or_no_labels(spark):
    assert langid.language_id(spark.createDataFrame([], SCHEMA)).collect() == []
    none = langid.language_id(spark.createDataFrame(made(20, ["aa", "bb"], 6, ""), SCHEMA).withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    one = langid.language_id(spark.createDataFrame(made(20, ["aa"], 7), SCHEMA)).collect()
    assert {r["lang_pred"] for r in one} == {"aa"}


def test_sums_of_grams_against_a_plain_loop(spark):
    """Windows that cut texts anywhere give the sums of the whole texts."""
    rnd = random.Random(8)
    texts = ["", "a", "Straße 12", "été à la plage", "x" * 50] + ["".join(rnd.choices("ab é", k=rnd.randrange(80))) for _ in range(20)]
    padded = [" " + t.lower() + " " * langid.PAD for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(padded)], ["text"])
    weights = np.random.RandomState(0).randint(-900, 900, (langid.HASHED, 3)).astype(np.int64)
    for size in (1, 7, 64, 10**6):
        sums = np.zeros((len(texts), 3), np.int64)
        for grams, _, rows, first, end in langid._windows(batch, size):
            sums[rows] += sum(langid._summed(weights[g], first, end) for g in grams)
        for t, total in zip(padded, sums, strict=True):
            data = langid._LETTERS[np.frombuffer(t.encode(), np.uint8)]
            assert (total == weights[langid.hashed_grams(data)].sum((0, 1))).all()


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 30])
def test_codes_can_correct(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n and (code.min(0) == 0).all() and (code.max(0) == 1).all()
    assert langid.distance(code) >= (2 ** (n - 2) if n <= 6 else 5)
