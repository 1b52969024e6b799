import random
import re

import pyarrow.parquet as pq

from tablesync.llm.queries import QUERIES
from tablesync.llm.secrets import assigned_findings, candidates, dictionary_coverage, secret_scan

SF = "/root/testdata/sf0.001"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


def test_query_finds_every_candidate(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    wanted = {(r["doc_id"], *m.span()) for r in rows for m in RUN.finditer(r["text"] or "")}
    found = QUERIES["op1_secret_scan"](spark, SF).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in found} == wanted and len(found) == len(wanted)


def labelled(spark, documents, n, seed):
    rng = random.Random(seed)
    texts, truth = [], {}
    for i in range(n):
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40])))
        word = "".join(rng.choice(["water", "house", "paper", "light", "stone"]) for _ in range(4))
        head = "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 12)))
        name = rng.choice(["token", "api_key", "id"])
        text = f"{head} {name} = \"{secret}\" and water house paper light stone {word} end"
        texts.append((i, text))
        truth[i, text.index(secret)], truth[i, text.index(word)] = True, False
    return documents(spark, texts), truth


def test_held_out_accuracy(spark, documents):
    docs, truth = labelled(spark, documents, 120, 1)
    found = candidates(docs, "doc_id", "text", "source")
    rows = [(r["doc_id"], r["row"], r["start"], truth[r["doc_id"], r["start"]] if r["doc_id"] < 60 else None) for r in found.collect()]
    labels = spark.createDataFrame(rows, "doc_id long, row long, start long, is_secret boolean")
    judged = secret_scan(docs, findings=labels).collect()
    held = [r for r in judged if r["doc_id"] >= 60]
    right = sum(r["kept"] == truth[r["doc_id"], r["start"]] for r in held)
    assert len(held) == 120 and right >= 114


def test_coverage_counts_corpus_words(spark, documents):
    docs = documents(spark, ["stone light"] * 5 + ["stonelight xx stone_light_stone_1"])
    got = [r["covered"] for r in dictionary_coverage(docs, "text", candidates(docs, "doc_id", "text", "source")).collect()]
    assert got == [15]


def test_odd_rows(spark, documents):
    docs = documents(spark, ["", None, "a" * 40_000, "é" + "Z9" * 10 + "\U0001f642" + "b" * 16, (None, "k" * 16), (7, "q" * 20), (7, "q" * 20)])
    docs = docs.selectExpr("*", "1 AS row", "2 AS start", "3 AS label", "4 AS value")
    got = sorted((str(r["doc_id"]), r["start"], r["end"], r["kept"]) for r in secret_scan(docs).collect())
    assert got == [
        ("2", 0, 40_000, False), ("3", 1, 21, False), ("3", 22, 38, False), ("7", 0, 20, False), ("None", 0, 16, False)
    ]
    assert secret_scan(docs.where("false")).count() == 0
    assert assigned_findings(candidates(documents(spark, ['my token: "abc123def456abc123"']), "doc_id", "text", "source")).first()["is_secret"]


def test_assignments_without_quotes_and_short_values(spark, documents):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 6)) + "a1b2c3"
    secrets = [key(32) for _ in range(60)]
    shapes = ["API_SECRET_KEY={}", "https://h.org/p?token={}&x=1", "export AUTH_TOKEN={}; run"]
    texts = [shapes[i % 3].format(s) for i, s in enumerate(secrets)] + [f"see water/house/paper/light{i}" for i in range(60)]
    texts += ["password = hunter2Xy9!", "user_password=hunter2Xy9", "one=two=three=four=five", "abcdefghij0123456789==", "API_KEY=YWJjZGVmZ2hpamts=="]
    docs = documents(spark, texts)
    found = {(r["doc_id"], r["value"]): r for r in candidates(docs, "doc_id", "text", "source").collect()}
    assert {(i, s) for i, s in enumerate(secrets)} <= set(found)
    assert [v for d, v in sorted(found) if d >= 120] == ["hunter2Xy9", "hunter2Xy9", "one=two=three=four=five", "abcdefghij0123456789==", "YWJjZGVmZ2hpamts=="]
    assert all(texts[d][r["start"] : r["end"]] == v for (d, v), r in found.items())
    kept = {(r["doc_id"], r["value"]) for r in secret_scan(docs).collect() if r["kept"]}
    assert {(i, s) for i, s in enumerate(secrets)} <= kept and not any(60 <= d < 120 for d, _ in kept)


def test_rare_findings_are_in_the_sample(spark, documents):
    rows = [f"see water/house/paper/light{i}" for i in range(400)] + [f'token = "{i}f00ba4deadbeef9c0ffee1234"' for i in range(10, 14)]
    kept = {r["doc_id"] for r in secret_scan(documents(spark, rows), sample_rows=20).collect() if r["kept"]}
    assert kept == {400, 401, 402, 403}


def planted(rng, i):
    """A text with one candidate, and whether that is a secret: with and without a telling name on either side."""
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(n))
    word = lambda: rng.choice(["water", "house", "paper", "light", "stone", "green", "table"])
    kind = i % 6
    if kind == 0:
        value, text, secret = (v := hexes(40)), f'token = "{v}"', True
    elif kind == 1:
        value, text, secret = (v := mixed(36)), f"Authorization: Bearer {v}", True
    elif kind == 2:
        value, text, secret = (v := mixed(32)), f"login with {v} today", True
    elif kind == 3:
        value, text, secret = (v := f"{word()}-{word()}-{word()}-{rng.randrange(1000, 9999)}"), f'api_key = "{v}"', False
    elif kind == 4:
        value, text, secret = (v := hexes(40)), f"commit {v} merged", False
    else:
        value, text, secret = (v := f"{word()}/{word()}/{word()}/{word()}{i}"), f"see {v} there", False
    return f"{word()} {word()}\n{text} {word()} {word()}", value, secret


def test_precision_and_recall_on_planted_findings(spark, documents):
    """Labels of one half teach the forest what the rule gets wrong on the other half."""
    rng = random.Random(11)
    rows = [planted(rng, i) for i in range(600)]
    docs = documents(spark, [r[0] for r in rows])
    found = candidates(docs, "doc_id", "text", "source").collect()
    truth = {(i, r[0].index(r[1])): r[2] for i, r in enumerate(rows)}
    assert {(r["doc_id"], r["start"]) for r in found} == set(truth)
    labels = [(r["doc_id"], r["row"], r["start"], truth[r["doc_id"], r["start"]] if r["doc_id"] % 12 < 6 else None) for r in found]
    labels = spark.createDataFrame(labels, "doc_id long, row long, start long, is_secret boolean")
    held = {k for k in truth if k[0] % 12 >= 6}

    def quality(kept):
        hits = sum(truth[k] for k in kept)
        return hits / max(len(kept), 1), hits / sum(truth[k] for k in held)

    learned = {(r["doc_id"], r["start"]) for r in secret_scan(docs, findings=labels).collect() if r["kept"]} & held
    rule = {(r["doc_id"], r["start"]) for r in assigned_findings(candidates(docs, "doc_id", "text", "source")).collect() if r["is_secret"]} & held
    precision, recall = quality(learned)
    print("learned", precision, recall, "rule", *quality(rule))
    assert precision >= 0.97 and recall >= 0.97
    # The rule keeps named values made of words and misses secrets without a name; the forest does neither.
    assert max(quality(rule)) < 0.75
    assert not any(k[0] % 6 == 3 for k in learned) and any(k[0] % 6 == 2 for k in learned)
