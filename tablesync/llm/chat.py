r"""Chat formatting from reply trees.

Messages form trees by parent id. Jump tables, built by joining the parent table with itself, hold each
message's ancestor 1, 2, 4, ... steps up; they give every message its depth and the total score of the
path above it in a logarithmic number of joins, however deep a tree is. Leaves are ranked by score within
their tree, and the paths of the chosen leaves are enumerated through the same tables. Each path becomes
one conversation.

Template: ``<s>[ROLE]role [/ROLE] text </s>`` per turn. A control string inside a role or text gets one
backslash in front; a control string without a backslash is the template's own. Reading back takes
exactly that backslash off, so every text returns unchanged.

Defined results: a NULL text or role is empty. A NULL or unknown parent makes a message a root. Messages
with a NULL id are left out; of messages that repeat an id within a tree the smallest by parent, role and
text stays. Messages that form a ring have no root and are in no conversation. A NULL score counts 0;
equal scores rank by id, smallest first. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablesync.llm.common import cut, whole

# Control strings of this template and of common chat templates.
CONTROL = r"(<s>|</s>|\[/?ROLE\]|\[/?INST\]|<</?SYS>>|<\|(?:im_start|im_end|endoftext|eot_id)\|>)"
TURN, BODY, END = "<s>[ROLE]", " [/ROLE] ", " </s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(whole(text), CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of (tree, id, up): the ancestor 2^k steps above; and (tree, id, depth, total) of all
    messages that have a root."""
    parents = nodes.select("tree", F.col("id").alias("parent"))
    known = nodes.join(parents, ["tree", "parent"], "left_semi").select("tree", "id", F.col("parent").alias("up"))
    state = cut(
        nodes.join(known, ["tree", "id"], "left").select(
            "tree", "id", "up", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")
        ),
        "jump",
    )
    # Only messages that haven't met their root move on, so a round costs what is still deeper than it.
    levels = []
    while (active := state.where("up IS NOT NULL")).limit(1).count():
        levels.append(active.select("tree", "id", "up"))
        above = state.select(
            "tree", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"),
            F.col("total").alias("_total"),
        )
        moved = active.join(above, ["tree", "up"]).select(
            "tree", "id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"),
            (F.col("total") + F.col("_total")).alias("total"),
        )
        new = cut(state.where("up IS NULL").unionByName(moved), "jump")
        # Each round brings some message to its root, until only rings are left.
        stuck = new.where("up IS NULL").count() == state.where("up IS NULL").count()
        state = new
        if stuck:
            break
    return levels, state.where("up IS NULL").select("tree", "id", "depth", "total")


def best_paths(messages: DataFrame, paths_per_tree: int = 1) -> DataFrame:
    """Turns of the chosen paths: ``tree``, ``leaf``, ``path_rank``, ``at`` (0 at the root), ``role``, ``text``.

    ``messages`` has tree, id, parent, role, text, score.
    """
    fields = F.struct("parent", whole(F.col("role")).alias("role"), whole(F.col("text")).alias("text"), "score")
    clean = cut(
        messages.where("id IS NOT NULL")
        .groupBy(F.col("tree").alias("tree"), "id")
        .agg(F.min(fields).alias("m"))
        .select("tree", "id", "m.parent", "m.role", "m.text", F.coalesce("m.score", F.lit(0.0)).alias("score")),
        "messages",
    )
    # Trees without an id are one tree; a plain key lets every join below be an equi-join.
    levels, rooted = jump_tables(clean.select("tree", "id", "parent", "score"))
    leaves = rooted.join(clean.select("tree", F.col("parent").alias("id")), ["tree", "id"], "left_anti")
    by_score = Window.partitionBy("tree").orderBy(F.desc("total"), "id")
    chosen = leaves.withColumn("path_rank", F.row_number().over(by_score)).where(
        F.col("path_rank") <= paths_per_tree
    )
    path = cut(
        chosen.select("tree", F.col("id").alias("leaf"), "path_rank", "id", (F.col("depth") - 1).alias("at")), "path"
    )
    for k in reversed(range(len(levels))):
        above = path.join(levels[k], ["tree", "id"]).where("up IS NOT NULL")
        path = cut(
            path.unionByName(
                above.select("tree", "leaf", "path_rank", F.col("up").alias("id"), (F.col("at") - 2**k).alias("at"))
            ),
            "path",
        )
    return path.join(clean, ["tree", "id"]).select("tree", "leaf", "path_rank", "at", "role", "text")


def format_chat(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per path of ``best_paths``: tree, leaf, path_rank, ``formatted`` and ``loss_mask``, an array
    of (start, length) in code points that covers the escaped texts of the trained role."""
    pieces = turns.select(
        "tree", "leaf", "path_rank", "at",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == trained_role).alias("trained"),
    )
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    placed = pieces.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct(
        "at", F.concat("head", "body", F.lit(END)).alias("piece"), "trained", "start",
        F.length("body").alias("length"),
    )
    listed = placed.groupBy("tree", "leaf", "path_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(
        F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))
    )
    return listed.select(
        "tree", "leaf", "path_rank",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        mask.alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, parsed from its text: an array of (role, text)."""
    chunks = F.filter(F.split(formatted, r"(?<!\\)<s>\[ROLE\]", -1), lambda c: c != "")
    parts = F.transform(chunks, lambda c: F.split(c, r" \[/ROLE\] ", 2))
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(p[0]).alias("role"),
            unescape(F.substring(p[1], F.lit(1), F.length(p[1]) - len(END))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the mask, unescaped, in order."""
    return F.transform(loss_mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"])))
