"""Secret scan: wide candidates, and a random forest that takes the false positives out.

Every unbroken run of at least ``MIN_CHARS`` key-like characters is a candidate. A run that holds an assignment
(``API_KEY=9f8e...``) is taken apart at its equals signs: parts of that length, and parts of at least
``MIN_VALUE`` characters after a secret-like name, are candidates in its place, and what stands before a part is
its neighbour; a run without such a part stays whole. Shorter runs of at least ``MIN_VALUE`` characters are
candidates where they are assigned to a secret-like name. The forest sees a candidate's length,
its character transitions, how much of it the corpus's own words cover, the path it comes from and its
neighbouring words. It is trained from labelled findings; where a caller has none, ``assigned_findings``
labels candidates by whether they are the value of an assignment to a secret-like name and look random.

The forest is fitted on at most ``SAMPLE_ROWS`` labelled candidates, those with the smallest hashes: of findings
up to half of them, whatever their share, and others for the rest. Words are counted over all documents and
every candidate is judged.

Defined results: NULL and empty texts have no candidates. A NULL path is a path of its own. Rows that repeat
id and text give their candidates once. If the labels in the sample are all alike, the label stands for
every candidate. Other columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import cut, lower_ascii, whole
from tablesync.llm.spans import CONTEXT, find_spans, share

MIN_CHARS = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
SECRET_NAME = r"(?i)(?:key|token|secret|passw(?:or)?d|pwd|credential|auth)[A-Za-z_]*[\"']?\s*(?::|=|=>)\s*[\"']?$"
MIN_VALUE = 8
# Short values with their names.
SHORT = (
    r"(?i:key|token|secret|passw(?:or)?d|pwd|credential|auth)[A-Za-z_]{0,32}[\"']?[\x20\t]{0,4}(?:=>|[:=])[\x20\t]{0,4}[\"']?"
    r"[A-Za-z0-9+/_-]{8,15}={0,2}(?![A-Za-z0-9+/_=-])"
)
SAMPLE_ROWS = 20_000
MIN_DOCUMENTS = 5
MIN_WORD = 3
TREES, DEPTH, BUCKETS = 24, 6, 32
PROBABLE = 0.5


def candidates(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    keep = (docs[path].cast("string").alias("path"),)
    # Four branches follow; stored, the texts are scanned once.
    spans = cut(find_spans(docs, docs[doc_id], docs[text], {"secret": CANDIDATE, "short": SHORT}, keep), "secret_spans")
    same = [c for c in spans.columns if c not in ("kind", "start", "end", "value", "before", "after")]
    runs = spans.where("kind = 'secret'")
    simple = ~F.col("value").rlike("=[^=]")
    # Parts of a run with their places: the text of each is what lies between its equals signs.
    parts = F.split(F.regexp_replace("value", "=+$", ""), "=")
    at = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,part:string>>").alias("parts")),
        lambda a, p: F.struct(
            (a["next"] + F.length(p) + 1).alias("next"),
            F.when(F.length(p) < MIN_VALUE, a["parts"])
            .otherwise(F.concat(a["parts"], F.array(F.struct(a["next"].alias("at"), p.alias("part")))))
            .alias("parts"),
        ),
    )["parts"]
    lead = lambda p: F.concat("before", F.substring("value", F.lit(1), p["at"]))
    good = F.filter(
        at,
        lambda p: (F.length(p["part"]) >= MIN_CHARS)
        | ((F.length(p["part"]) >= MIN_VALUE) & lead(p).rlike(SECRET_NAME)),
    )
    bare = F.length(F.regexp_replace("value", "=+$", ""))
    padded = F.transform(
        good,
        lambda p: F.struct(
            p["at"].alias("at"),
            F.when(p["at"] + F.length(p["part"]) == bare, F.concat(p["part"], F.expr("substring(value, length(rtrim('=', value)) + 1)")))
            .otherwise(p["part"])
            .alias("part"),
        ),
    )
    opened = runs.where(~simple).withColumn("_good", padded)
    start = F.col("start") + F.col("_p.at")
    taken = (
        opened.where(F.size("_good") > 0)
        .select("*", F.explode("_good").alias("_p"))
        .select(
            *same,
            start.alias("start"),
            (start + F.length("_p.part")).alias("end"),
            F.col("_p.part").alias("value"),
            F.right(lead(F.col("_p")), F.lit(CONTEXT)).alias("before"),
            F.left(F.concat(F.expr("substring(value, _p.at + length(_p.part) + 1)"), "after"), F.lit(CONTEXT)).alias("after"),
        )
    )
    named = F.regexp_extract("value", "[A-Za-z0-9+/_-]+=*$", 0)
    # Part of a long run, a value is there already.
    short = (
        spans.where("kind = 'short'")
        .where(~F.concat("before", "value").rlike("[A-Za-z0-9+/_=-]{16,}$"))
        .withColumn("_value", named)
        .select(
            *same,
            (F.col("end") - F.length("_value")).alias("start"),
            "end",
            F.col("_value").alias("value"),
            F.right(F.expr("concat(before, substring(value, 1, length(value) - length(_value)))"), F.lit(CONTEXT)).alias("before"),
            "after",
        )
    )
    plain = runs.where(simple).unionByName(opened.where(F.size("_good") == 0).drop("_good")).drop("kind")
    return plain.unionByName(taken).unionByName(short)


def assigned_findings(found: DataFrame) -> DataFrame:
    """Labels (doc_id, row, start, is_secret) by rule: the value of a secret-like name, with digits among its letters."""
    least = F.when(F.length("value") < MIN_CHARS, 1).otherwise(3)
    random_like = (share("[0-9]", F.col("value")) >= least) & (share("[A-Za-z]", F.col("value")) >= 3)
    return found.select("doc_id", "row", "start", (F.col("before").rlike(SECRET_NAME) & random_like).alias("is_secret"))


def _runs(value: Column) -> Column:
    """Letter runs of a candidate, lower-cased."""
    return F.filter(
        F.split(lower_ascii(value), "[^a-z]+"), lambda w: F.length(w) >= MIN_WORD
    )


def dictionary_coverage(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """(doc_id, row, start, covered): characters of each candidate in words that ``MIN_DOCUMENTS`` documents have."""
    keys = ["doc_id", "row", "start"]
    parts = found.select(*keys, F.explode(_runs(F.col("value"))).alias("word"))
    words = docs.select(
        F.explode(F.array_distinct(F.filter(F.split(lower_ascii(whole(docs[text])), "[^a-z]+"), lambda w: F.length(w) >= MIN_WORD))).alias("word")
    )
    # Words are counted before they meet the candidates: one row per word and task moves.
    common = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCUMENTS).select("word")
    return parts.join(common, "word").groupBy(*keys).agg(F.sum(F.length("word")).alias("covered"))


def _class(pattern_from: str, pattern_to: str, value: Column) -> Column:
    """Neighbouring characters of which the first and second match these classes."""
    return F.size(F.regexp_extract_all(value, F.lit(f"{pattern_from}(?={pattern_to})"), F.lit(0)))


def features() -> dict[str, Column]:
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    n = F.length("value")
    classes = {"u": "[A-Z]", "l": "[a-z]", "d": "[0-9]", "s": "[+/_=-]"}
    moves = {
        f"{a}{b}": _class(classes[a], classes[b], value) / n for a in classes for b in classes
    }
    bucket = lambda word: F.pmod(F.xxhash64(F.coalesce(F.lower(word), F.lit(""))), F.lit(BUCKETS))
    words_before = F.split(F.trim(F.regexp_replace(before, r"[^\p{L}\p{N}]+", " ")), " ")
    words_after = F.split(F.trim(F.regexp_replace(after, r"[^\p{L}\p{N}]+", " ")), " ")
    return {
        "length": n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "vowels": share("[aeiouAEIOU]", value) / n,
        **moves,
        "covered": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "path": F.pmod(F.xxhash64("path"), F.lit(BUCKETS)),
        "path_depth": share("/", F.coalesce("path", F.lit(""))),
        "word_before": bucket(F.element_at(words_before, -1)),
        "word_after": bucket(F.get(words_after, 0)),
        "quoted": F.when(before.rlike("[\"']$"), 1).otherwise(0),
        "assigned": F.when(before.rlike("[:=]\\s*[\"']?$"), 1).otherwise(0),
    }


def secret_scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str = "source",
    findings: DataFrame | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), value, score (probability) and kept.

    ``findings`` (doc_id, row, start, is_secret) labels candidates of ``candidates``; a NULL or missing label
    is no example.
    """
    found = cut(candidates(docs, doc_id, text, path), "secret_candidates")
    covered = dictionary_coverage(docs, text, found).withColumnsRenamed({"doc_id": "c_id", "row": "c_row", "start": "c_start"})
    labels = (assigned_findings(found) if findings is None else findings).select(
        F.col("doc_id").alias("l_id"), F.col("row").alias("l_row"), F.col("start").alias("l_start"),
        F.col("is_secret").cast("double").alias("label"),
    )

    def same(prefix: str) -> Column:
        return (
            F.col("doc_id").eqNullSafe(F.col(f"{prefix}_id"))
            & (F.col("row") == F.col(f"{prefix}_row"))
            & (F.col("start") == F.col(f"{prefix}_start"))
        )

    joined = found.join(covered, same("c"), "left").join(labels, same("l"), "left")
    measured = cut(
        joined.select(
            "doc_id", "row", "start", "end", "value", "label", F.xxhash64("doc_id", "row", "start").alias("place"),
            *(c.cast("double").alias(f"f_{name}") for name, c in features().items()),
        ),
        "secret_features",
    )
    inputs = [c for c in measured.columns if c.startswith("f_")]
    known = measured.where("label IS NOT NULL").select("place", "label", *inputs)
    positive = cut(known.where("label = 1").orderBy("place").limit(sample_rows // 2), "secret_positive")
    others = known.where("label = 0").orderBy("place").limit(sample_rows - positive.count())
    sample = cut(positive.unionByName(others), "secret_sample")
    seen = [r[0] for r in sample.select("label").distinct().collect()]
    vectors = VectorAssembler(inputCols=inputs, outputCol="features")
    if len(seen) < 2:
        score = F.lit(seen[0] if seen else 0.0)
        judged = measured.withColumn("score", score)
    else:
        # The sample is bounded; one partition in one order makes the trees the same in every run.
        train = vectors.transform(sample.coalesce(1).sortWithinPartitions("place")).select("features", "label")
        model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1).fit(train)
        judged = model.transform(vectors.transform(measured)).withColumn(
            "score", F.round(vector_to_array("probability")[1], 6)
        )
    return judged.select("doc_id", "start", "end", "value", "score", (F.col("score") >= PROBABLE).alias("kept"))
