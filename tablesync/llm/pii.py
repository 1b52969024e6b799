"""Personal data: candidate spans, gradient boosting, calibrated thresholds.

Generators with high recall propose spans of each kind, overlapping at will. Boosted trees score a span by
its format (digits, separators, check sum, length) and its context (neighbouring characters and cue words).
They learn from labels a caller brings or from evidence (``evident``): a base match is a finding, and so is what
gives one when normalised (spelled-out or bracketed addresses, octets, check sums over other separators) or what a
cue word announces (phones without +, spaced-out forms). What contradicts its kind, or has neither evidence nor a
cue, is none; a form that could be either is no example. A held-out third calibrates one threshold per
kind, the lowest score from which ``MIN_PRECISION`` of the candidates are findings. Candidates above it are added
where they overlap no base span and no better one; base spans always stay.

The model is fitted on every labelled candidate. Features are whole numbers up to ``MOST``, so candidates are counted by
their features first and the trees learn from distinct feature rows that weigh as much as the candidates they stand for;
a kind and class with more than ``EACH_WEIGHT`` candidates weighs as many in all, so that frequent ones don't drown the
rest. Split points are all values that occur. Calibration counts all held-out candidates, every candidate is scored.

Defined results: NULL and empty texts have no spans. Rows that repeat id and text have the same spans, a
row each. With no candidates of both classes to learn from nothing is added. Other columns are ignored.
No rows in, no rows out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import cut, whole
from tablesync.llm.spans import find_spans, luhn_valid, share

KINDS = ("email", "ip", "card", "phone")
EACH_WEIGHT = 2_500
MOST = 255
TASK_VECTORS = 200_000  # distinct feature rows a task of the fit holds
HELD_OUT = 3  # one candidate in so many calibrates
MIN_PRECISION = 0.98
MIN_FINDINGS = 20
BINS = 100

# Possessive forms and the look-behinds keep matching linear on any text; the matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++"
    r"(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\x20?[.\[\]()]{1,3}\x20?[0-9]{1,3}){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,22}+",
    "phone": r"(?<![0-9])\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,17}+",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
CUES = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|pay|credit",
    "phone": "phone|tel|call|mobile|fax",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", (n >= 14) & (n <= 19) & luhn_valid(_digits(value)))
        .otherwise((n >= 10) & (n <= 15))
    )


def base_spans(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    found = find_spans(docs, doc_id, text, BASE)
    return found.where(base_valid(F.col("kind"), F.col("value"))).select("doc_id", "row", "kind", "start", "end")


def evident(kind: Column, value: Column, before: Column) -> Column:
    """Whether a candidate that is no base match is a finding by evidence: true, false, or NULL for unknown."""
    digits = _digits(value)
    n = F.length(digits)
    ahead = lambda k: before.rlike(rf"(?i)\b(?:{CUES[k]})[a-z]*[^0-9]{{0,24}}$")
    bracketed = value.rlike(r"(?:\(at\)|\[at\])") | (value.rlike("\x20at\x20") & value.rlike("\x20dot\x20|[(\\[]dot[)\\]]"))
    # Brackets and blanks around dots go; a base address must be left.
    plain = F.regexp_replace(value, r"[\[\]()\x20]", "")
    octets = plain.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    luhn = (n >= 14) & (n <= 19) & luhn_valid(digits) & (F.size(F.array_distinct(F.split(digits, ""))) > 2)
    grouped = value.rlike(r"^[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){3}$")
    unknown = F.lit(None).cast("boolean")
    return (
        F.when(kind == "email", F.when(bracketed | ahead("email"), True).when(value.contains("@"), unknown).otherwise(False))
        .when(kind == "ip", F.when(~octets, False).when(ahead("ip") | value.rlike(r"[\[(]"), True).otherwise(unknown))
        .when(kind == "card", F.when(~luhn, False).when(ahead("card") | grouped, True).otherwise(unknown))
        .otherwise(F.when((n < 7) | (n > 15), False).otherwise(ahead("phone")))
    )


def features() -> dict[str, Column]:
    value, before, after = F.col("value"), F.lower("before"), F.lower("after")
    digits = _digits(value)
    cue = reduce(
        lambda column, kind: column.when(F.col("kind") == kind, before.rlike(rf"(?:{CUES[kind]})")),
        KINDS[1:],
        F.when(F.col("kind") == KINDS[0], before.rlike(rf"(?:{CUES[KINDS[0]]})")),
    )
    flags = {
        "luhn": F.when(F.length(digits) <= 24, luhn_valid(digits)).otherwise(False),
        "octets": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "plus": value.startswith("+"),
        "at_sign": value.contains("@"),
        "spelled": value.rlike("[(\\[]|\x20(?:at|dot)\x20"),
        "cue": cue,
        "joined_before": before.rlike(r"[\p{L}0-9._/-]$"),
        "joined_after": after.rlike(r"^[\p{L}0-9_/-]"),
    }
    numbers = {
        "length": F.length(value),
        "digits": F.length(digits),
        "letters": share("[A-Za-z]", value),
        "separators": share(r"[\x20()./-]", value),
        "dots": share("[.]", value),
        "digits_around": share("[0-9]", before) + share("[0-9]", after),
        "different_digits": F.size(F.array_distinct(F.split(digits, ""))),
        **{f"is_{kind}": F.when(F.col("kind") == kind, 1).otherwise(0) for kind in KINDS},
    }
    return {
        **{k: F.when(v, 1.0).otherwise(0.0) for k, v in flags.items()},
        **{k: F.least(v, F.lit(MOST)).cast("double") for k, v in numbers.items()},
    }


def scored(candidates: DataFrame) -> DataFrame | None:
    """``candidates`` (with ``finding`` and ``label``, NULL for no example) plus ``score`` and ``accepted``; None if
    there is nothing to learn from."""
    measured = candidates.select(
        "doc_id", "row", "kind", "start", "end", "finding", F.col("label").cast("double").alias("label"),
        *(c.alias(f"f_{n}") for n, c in features().items()),
    )
    inputs = [c for c in measured.columns if c.startswith("f_")]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    held_out = F.pmod(F.xxhash64("doc_id", "row", "kind", "start", "end"), F.lit(HELD_OUT)) == 0
    counted = cut(
        measured.where("label IS NOT NULL")
        .groupBy("kind", "label", held_out.alias("held_out"), *inputs)
        .agg(F.count("*").alias("n")),
        "pii_vectors",
    )
    learn = counted.where(~F.col("held_out"))
    strata = learn.groupBy("kind", "label").agg(F.sum("n").alias("n"), F.count("*").alias("vectors")).collect()
    if len({r["label"] for r in strata}) < 2:
        return None
    each = F.lit(1.0)
    for r in sorted(strata, key=lambda r: (r["kind"], r["label"])):
        here = (F.col("kind") == r["kind"]) & (F.col("label") == r["label"])
        each = F.when(here, min(1.0, EACH_WEIGHT / r["n"])).otherwise(each)
    vectors = sum(r["vectors"] for r in strata)
    # Rows in one order make the trees the same in every run, as long as they fit a task; beyond that, sums of
    # several tasks may differ in their last digits.
    train = learn.withColumn("weight", F.col("n") * each).repartition(-(-vectors // TASK_VECTORS), *inputs)
    train = assembler.transform(train.sortWithinPartitions("kind", "label", *inputs))
    # Spark looks for split points in bins * bins rows: so many bins that these are all.
    bins = max(MOST + 1, math.isqrt(vectors) + 1)
    trees = GBTClassifier(maxIter=12, maxDepth=4, maxBins=bins, weightCol="weight", seed=1)
    model = trees.fit(train.select("features", "label", "weight", "n"))
    score = F.round(vector_to_array("probability")[1], 6)
    held = model.transform(assembler.transform(counted.where("held_out"))).groupBy(
        "kind", F.floor(score * BINS).alias("bin")
    ).agg(F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n"))
    thresholds = dict.fromkeys(KINDS, 2.0)
    for kind in KINDS:
        hits = total = 0.0
        for r in sorted((r for r in held.where(F.col("kind") == kind).collect()), key=lambda r: -r["bin"]):
            hits, total = hits + r["hits"], total + r["n"]
            if hits >= MIN_PRECISION * total and hits >= MIN_FINDINGS:
                thresholds[kind] = r["bin"] / BINS
    least = reduce(lambda c, k: c.when(F.col("kind") == k, thresholds[k]), KINDS, F.when(F.lit(False), 2.0))
    return (
        model.transform(assembler.transform(measured))
        .select("doc_id", "row", "kind", "start", "end", "finding", score.alias("score"))
        .withColumn("accepted", F.col("score") >= least)
    )


def _listed(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _span(order: Column) -> Column:
    return F.struct(F.col("start").alias("start"), order.alias("order"), F.col("end").alias("end"), F.col("kind").alias("kind"))


def find_personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", labels: DataFrame | None = None
) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base, spans (as text:
    kind:start:end by start, then kind).

    ``labels`` (doc_id, row, kind, start, end, is_personal) labels proposed spans instead of the evidence; a NULL or
    missing label is no example.
    """
    names = F.array(*(F.lit(k) for k in KINDS))
    order = F.array_position(names, F.col("kind"))
    base = cut(base_spans(docs, docs[doc_id], docs[text]), "pii_base")
    keys = ["doc_id", "row", "kind", "start", "end"]
    proposed = find_spans(docs, docs[doc_id], docs[text], PROPOSED)
    hits = base.select(*(F.col(k).alias(f"b_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (proposed[k].eqNullSafe(hits[f"b_{k}"]) for k in keys))
    finding = F.col("b_start").isNotNull()
    judged_by = F.when(finding, True).otherwise(evident(F.col("kind"), F.col("value"), F.col("before")))
    matched = proposed.join(hits, same, "left").select(
        *keys, "value", "before", "after", finding.alias("finding"), judged_by.alias("label")
    )
    if labels is not None:
        given = labels.select(*(F.col(k).alias(f"l_{k}") for k in keys), F.col("is_personal"))
        known = reduce(lambda a, b: a & b, (matched[k].eqNullSafe(given[f"l_{k}"]) for k in keys))
        matched = matched.join(given, known, "left").select(
            *keys, "value", "before", "after", "finding", F.col("is_personal").alias("label")
        )
    candidates = cut(matched, "pii_candidates")
    by_text = base.groupBy("doc_id", "row").agg(
        F.collect_list(_span(order)).alias("base"),
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS),
    )
    judged = scored(candidates)
    if judged is None:
        judged = candidates.withColumn("score", F.lit(0.0)).withColumn("accepted", F.lit(False))
    extra = judged.where(F.col("accepted") & ~F.col("finding")).groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worst"), _span(order).alias("span")))).alias("extra")
    )
    x = extra.select(F.col("doc_id").alias("x_id"), F.col("row").alias("x_row"), "extra")
    merged = by_text.join(x, by_text["doc_id"].eqNullSafe(x["x_id"]) & (by_text["row"] == x["x_row"]), "full_outer").select(
        F.coalesce("doc_id", "x_id").alias("s_id"), F.coalesce("row", "x_row").alias("s_row"), *(f"n_{k}" for k in KINDS),
        F.coalesce("base", F.array()).alias("base"), F.coalesce("extra", F.array()).alias("extra"),
    )
    everything = F.aggregate(
        "extra",
        F.col("base"),
        lambda taken, c: F.when(
            F.exists(taken, lambda t: (t["start"] < c["span"]["end"]) & (c["span"]["start"] < t["end"])), taken
        ).otherwise(F.concat(taken, F.array(c["span"]))),
    )
    found = merged.select("s_id", "s_row", *(f"n_{k}" for k in KINDS), _listed(F.col("base")).alias("base"), _listed(everything).alias("spans"))
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(whole(docs[text])).alias("row"))
    return plain.join(found, plain["doc_id"].eqNullSafe(found["s_id"]) & (plain["row"] == found["s_row"]), "left").select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.coalesce("base", F.lit("")).alias("base"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
