import hashlib
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tablesync.llm import pii
from tablesync.llm.pii import KINDS, PROPOSED, find_personal_data, scored
from tablesync.llm.queries import QUERIES
from tablesync.llm.spans import find_spans

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text) if valid(kind, m[0])]
    counts = tuple(sum(k == i for _, k, _ in found) for i in range(4))
    return counts, ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def split(spans):
    return {tuple(s.split(":")) for s in spans.split(",")} - {("",)}


def test_query_keeps_base_spans(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = QUERIES["op10_personal_data"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        counts, listed = base(texts[r["doc_id"]])
        assert tuple(r[f"n_{k}"] for k in KINDS) == counts
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert split(listed) <= split(r["spans"])


def test_odd_texts(spark, documents):
    texts = [
        "", None, "a@b", "a@b.c.", "x.a@b.c_d@e.f", "é🙂 me@x.org,you@y.z", "256.1.1.1 0255.000.1.9 1.2.3.4.5.6.7.8.9",
        "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (743) 555-3824. +123 +44 20 7946 0958 00", "1" * 50_000, "a" * 50_000,
        "a." * 20_000 + "@" + "b." * 20_000 + "c", "+" + "1 " * 30_000, "(" * 9000, "1.1.1.1" * 500,
    ]
    docs = documents(spark, texts).selectExpr("*", "1 AS row", "2 AS start", "3 AS kind", "4 AS spans")
    got = {r["doc_id"]: r for r in find_personal_data(docs).collect()}
    for i, text in enumerate(texts):
        counts, listed = base(text or "")
        assert (tuple(got[i][f"n_{k}"] for k in KINDS), got[i]["base"]) == (counts, listed), i
    assert find_personal_data(docs.where("false")).count() == 0


def test_repeated_rows_and_null_ids(spark, documents):
    docs = documents(spark, [(1, "a@b.c"), (1, "a@b.c"), (1, "no"), (None, "x d@e.f")])
    got = sorted((str(r["doc_id"]), r["spans"]) for r in find_personal_data(docs).collect())
    assert got == [("1", ""), ("1", "email:0:5"), ("1", "email:0:5"), ("None", "email:2:7")]


def test_learned_spans(spark, documents):
    """Spaced-out addresses look like findings and are added; plain numbers are left alone."""
    texts = [f"mail user{i}@mail{i % 7}.example.com please" for i in range(150)] + [f"look at x{i} at y. nothing 12{i} here" for i in range(150)]
    docs = documents(spark, [*texts, "plain words 12345 and no more"])
    got = {r["doc_id"]: r for r in find_personal_data(docs).collect()}
    assert all(got[i]["n_email"] == 1 for i in range(150))
    assert all(got[i]["spans"] == "" for i in range(150, 301))


def test_places_of_proposals(spark, documents):
    text = "é call (020) 7946 0958 or a [at] b [dot] org"
    docs = documents(spark, [text])
    found = find_spans(docs, docs["doc_id"], docs["text"], PROPOSED).collect()
    assert {(r["kind"], text[r["start"] : r["end"]]) for r in found} == {("phone", "(020) 7946 0958"), ("email", "a [at] b [dot] org")}


def test_forms_outside_the_base_are_added(spark, documents):
    texts = [f"write to user{i} [at] mail{i % 7} [dot] org please" for i in range(150)]
    texts += [f"you can call ({200 + i}) 7946 {1000 + 7 * i} today" for i in range(150)]
    texts += [f"mail user{i}@example.org" if i % 2 else f"ring +44 20 7946 {1000 + i}" for i in range(150)]
    texts += [f"a total of {1234567000 + 31 * i} items" for i in range(300)]
    got = {r["doc_id"]: r["spans"] for r in find_personal_data(documents(spark, texts)).collect()}
    assert all(got[i].startswith("email:9:") for i in range(150))
    assert all(got[i].startswith("phone:13:") for i in range(150, 300))
    assert all(got[i] == "" for i in range(450, 750))


def test_labels_of_a_caller(spark, documents):
    docs = documents(spark, [f"ref {f'555/{100 + i}/{1000 + i}' if i % 2 else 5550000000 + 37 * i}" for i in range(400)])
    found = find_spans(docs, docs["doc_id"], docs["text"], PROPOSED)
    labels = found.selectExpr("doc_id", "row", "kind", "start", "end", "value LIKE '%/%' AS is_personal")
    got = {r["doc_id"]: r["spans"] for r in find_personal_data(docs, labels=labels).collect()}
    assert got == {i: "phone:4:16" if i % 2 else "" for i in range(400)}


def test_every_labelled_candidate_is_learned_from(spark, monkeypatch):
    """12,000 candidates of a kind, of which a few have a form of their own: all weigh in fit and calibration."""
    candidates = spark.range(12_000).selectExpr(
        "id AS doc_id", "0L AS row", "'phone' AS kind", "4 AS start", "14 AS end", "'ref ' AS before", "'' AS after",
        "CASE WHEN id % 100 = 0 THEN '555/1234' WHEN id % 2 = 0 THEN '(555) 1234' ELSE '5551234' END AS value",
        "false AS finding", "id % 2 = 0 AS label",
    )
    seen = {}

    class Trees(pii.GBTClassifier):
        def fit(self, data, params=None):
            n = "n" if "n" in data.columns else "1"
            seen["n"], seen["rows"] = data.agg(F.expr(f"sum({n})"), F.count("*")).first()
            return super().fit(data, params)

    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    held = F.pmod(F.xxhash64("doc_id", "row", "kind", "start", "end"), F.lit(pii.HELD_OUT)) == 0
    judged = scored(candidates)
    assert seen["n"] == candidates.where(~held).count() and seen["rows"] == 3
    assert {r["doc_id"] for r in judged.where("accepted").collect()} == set(range(0, 12_000, 2))
