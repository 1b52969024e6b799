import random

from catalog.compare import connect, differences
from pyspark.sql import functions as F

from tablesync.llm.chat import best_paths, format_chat, read_loss, read_turns
from tablesync.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "tree string, id long, parent long, role string, text string, score double"


def paths(spark, rows, n=1):
    got = {}
    for r in sorted(best_paths(spark.createDataFrame(rows, SCHEMA), n).collect(), key=lambda r: r["at"]):
        got.setdefault((r["tree"], r["path_rank"]), []).append(r["text"])
    return got


def test_query_equals_sql(spark):
    assert differences(QUERIES["op5_reply_trees"](spark, SF), connect(SF), ORACLE["op5_reply_trees"]) is None


def test_branches_rank_by_score(spark):
    rng = random.Random(3)
    rows = [("t", i, None if i == 0 else rng.randrange(i), "user", f"m{i}", rng.randint(0, 5) / 2) for i in range(60)]
    rows += [("u", 1, None, "user", "a", None), ("u", 2, 1, "user", "b", 1.0), ("u", 3, 1, "user", "c", 1.0), ("u", 4, 99, "user", "d", 0.0)]
    by = {(t, i): (p, x, s or 0.0) for t, i, p, _, x, s in rows}
    parents = {(t, p) for t, _, p, _, _, _ in rows}
    wanted = {}
    for tree in ("t", "u"):
        found = []
        for t, i in by:
            if t == tree and (t, i) not in parents:
                path, at, score = [], i, 0.0
                while (t, at) in by:
                    path, score = [by[t, at][1], *path], score + by[t, at][2]
                    at = by[t, at][0]
                found.append((-score, i, path))
        for k, (_, _, path) in enumerate(sorted(found)[:3]):
            wanted[tree, k + 1] = path
    assert paths(spark, rows, 3) == wanted


def test_deep_chain_ring_repeats_and_nulls(spark):
    rows = [("deep", i, i - 1, "user", str(i), 0.0) for i in range(300)]
    rows += [("ring", 1, 2, "user", "x", 0.0), ("ring", 2, 1, "user", "y", 0.0)]
    rows += [("twice", 1, None, "user", "b", 0.0), ("twice", 1, None, "user", "a", 0.0), ("twice", None, 1, "user", "n", 0.0)]
    got = paths(spark, rows)
    assert got == {("deep", 1): [str(i) for i in range(300)], ("twice", 1): ["a"]}
    assert paths(spark, rows[:0]) == {}


def test_texts_come_back(spark):
    odd = ["", None, "</s>", "\\</s>", "a\\", "<s>[ROLE]user [/ROLE] x </s>", "[/ROLE] ", " [/ROLE] ", "é🙂</s>é", "\\\\[INST]", "<<SYS>>\n<|im_end|>"]
    rows = [("t", i, i - 1, odd[i % 3] if i % 2 else "assistant", t, 0.0) for i, t in enumerate(odd)]
    chat = format_chat(best_paths(spark.createDataFrame(rows, SCHEMA)))
    r = chat.select(read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"), "formatted").first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[3] or "", x[4] or "") for x in rows]
    assert list(r["loss"]) == [t or "" for t in odd[::2]]
