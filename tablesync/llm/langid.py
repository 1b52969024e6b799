"""Language identification by error-correcting output codes.

Every learned language has a codeword. One binary classifier per bit tells, from hashed n-grams of the lower-cased
UTF-8 bytes, whether a text's language has that bit set; the nearest codeword under a weighted loss is the answer.

* Counting: n-gram counts per language over all labelled texts of the learning part, summed by Spark. A task
  emits at most one number per language and hash value.
* Weights: for a bit, the log-odds of a hash value between the languages with and without it, each language
  weighing the same however many texts it has. Whole numbers, so that sums agree in any order.
* Calibration: on a quarter of the learning part that isn't counted. A text's mean weight is taken as normal
  around its language's mean with a variance that falls with length; that gives slope and threshold of a bit. A
  bit's vote weighs by its error there.
* Decoding: the language with the smallest weighted logistic loss. ``ambiguous`` says that its softmax is under
  ``SURE``, or that the hard bits are farther from its codeword than the code can correct.

Only the model goes through the driver: ``HASHED`` rows of one small number per bit.

Defined results: NULL text, or text without a letter, is ``und`` with score 0, as is every text where no label is
learned; with one learned language that one is the answer. A NULL id is not held out and not learned from. Rows that
repeat an id have a row each; other columns are ignored, whatever their names; no rows in, no rows out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import cut, ship_code, whole

GRAMS = (2, 3, 4)
HASHED = 1 << 16
SMOOTH = 0.5
SCALE = 256  # weights are whole multiples of 1/256
PARTS = 4  # documents are dealt by crc32(doc_id) % PARTS
HELD_OUT = 2
EXHAUSTIVE = 6  # languages up to which every split is a bit
TRIES = 64
SURE = 0.9
UNKNOWN = "und"
PAD = max(GRAMS)
VALUES = 1 << 22  # numbers held by one step of a task
MOST_HELD = 64  # languages a task counts before it emits

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


# -- n-grams of a batch ---------------------------------------------------------------


def hashed_grams(data: np.ndarray) -> np.ndarray:
    """Hash values of the n-grams that start at each byte but the last ``PAD - 1``: one row per n."""
    n = len(data) - PAD + 1
    code = np.zeros(n, np.uint32)
    for k in range(PAD):
        code |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    out = np.empty((len(GRAMS), n), np.uint32)
    for row, size in enumerate(GRAMS):
        part = code & np.uint32((1 << 8 * size) - 1)
        part *= np.uint32(2654435761)
        part ^= np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)
        part *= np.uint32(2246822519)
        out[row] = part >> np.uint32(32 - HASHED.bit_length() + 1)
    return out


_BLANK = hashed_grams(np.full(PAD, 32, np.uint8))[:, 0]


def _windows(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """Pieces of a batch's texts: (hash values, bytes, row numbers, first and end position of each row)."""
    text = batch.column("text")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, ends, values = text.buffers()
    ends = np.frombuffer(ends, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    if len(text) == 0 or ends[-1] == ends[0]:
        return
    data = _LETTERS[np.frombuffer(values, np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    # Each text ends in PAD spaces: grams that start before the last PAD - 1 of them are its own.
    starts, stops = ends[:-1], np.maximum(ends[:-1], ends[1:] - PAD + 1)
    for low in range(0, int(stops[-1]), size):
        high = min(low + size, int(stops[-1]))
        rows = np.arange(np.searchsorted(stops, low, "right"), np.searchsorted(starts, high, "left"))
        first, end = np.clip(starts[rows], low, high) - low, np.clip(stops[rows], low, high) - low
        held = first < end
        yield hashed_grams(data[low : high + PAD - 1]), data[low:high], rows[held], first[held], end[held]


def _summed(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between first and end, per row."""
    padded = np.concatenate([values, np.zeros_like(values[:1])])
    return np.add.reduceat(padded, np.stack([first, end], 1).ravel(), axis=0, dtype=np.int64)[::2]


# -- learning -------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        names, label = np.unique(np.array(batch.column("label").to_pylist(), object).astype(str), return_inverse=True)
        for grams, data, rows, first, end in _windows(batch, VALUES):
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, first, 1)
            np.add.at(inside, end, -1)
            inside = np.cumsum(inside[:-1]) > 0
            of = np.repeat(label[rows], end - first)
            for name in np.unique(of):
                mine = grams[:, inside][:, of == name].ravel()
                held[names[name]] = held.get(names[name], 0) + np.bincount(mine, minlength=HASHED)
        if len(held) > MOST_HELD:
            yield from _counts(held)
            held = {}
    yield from _counts(held)


def _counts(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for label, counts in held.items():
        counts[_BLANK] = 0
        (at,) = counts.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())],
            ["label", "gram", "n"],
        )


def codewords(n: int) -> np.ndarray:
    """A row of bits per language. Few languages get every split of them, more a code of 10 log2 n columns, the one
    of ``TRIES`` fixed draws whose closest rows are farthest apart."""
    if n < 2:
        return np.zeros((n, 0), np.int64)
    if n <= EXHAUSTIVE:
        split = np.arange(2 ** (n - 1) - 1)
        return np.stack([np.ones_like(split), *((split >> k) & 1 for k in range(n - 1))])
    bits = int(np.ceil(10 * np.log2(n)))
    rnd, best = np.random.RandomState(n), None
    for _ in range(TRIES):
        drawn = rnd.randint(0, 2, (n, bits))
        drawn = drawn[:, (drawn.min(0) == 0) & (drawn.max(0) == 1)]
        if best is None or distance(drawn) > distance(best):
            best = drawn
    return best


def distance(code: np.ndarray) -> int:
    """Hamming distance of the closest two codewords."""
    return min((int((a != b).sum()) for a, b in itertools.combinations(code, 2)), default=0)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # HASHED x bits


def _literal(values: np.ndarray, kind: str = "int") -> Column:
    return F.lit([v.item() for v in values]).cast(f"array<{kind}>") if len(values) else F.array().cast(f"array<{kind}>")


def learned(texts: DataFrame) -> Model:
    """The model of ``texts`` (label, text as ``prepared`` gives it)."""
    counts = cut(
        texts.select("label", "text").mapInArrow(_count, "label string, gram int, n long")
        .groupBy("label", "gram").agg(F.sum("n").alias("n")),
        "language_grams",
    )
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    code = codewords(len(languages))
    weights = np.zeros((HASHED, code.shape[1]), np.int16)
    if not code.shape[1]:
        return Model(languages, code, weights)
    share = np.array([1 / (totals[x] + SMOOTH * HASHED) for x in languages])
    place = F.array_position(F.lit(languages), F.col("label")).cast("int") - 1
    # The languages of a hash value in a fixed order, so that sums agree to the last digit.
    held = counts.select("gram", F.struct(place.alias("at"), "n").alias("x")).groupBy("gram").agg(
        F.array_sort(F.collect_list("x")).alias("held")
    )

    def side(bit: np.ndarray) -> Column:
        """Mean probability over the languages of one side."""
        each = _literal(np.where(bit, share / bit.sum(), 0.0), "double")
        start = float((share * bit).sum() / bit.sum() * SMOOTH)
        return F.aggregate("held", F.lit(start), lambda a, x: a + x["n"] * F.get(each, x["at"]))

    bits = [F.round(SCALE * F.log(side(b == 1) / side(b == 0))).cast("int") for b in code.T]
    for row in held.select("gram", F.array(*bits).alias("w")).toLocalIterator():
        weights[row["gram"]] = np.clip(row["w"], -(2**15), 2**15 - 1)
    return Model(languages, code, weights)


# -- margins, calibration, decoding ---------------------------------------------------


def margins(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` without the text: its number of letter bytes and the summed weights of its n-grams, per bit."""
    weights = texts.sparkSession.sparkContext.broadcast(model.weights)
    columns = [c for c in texts.columns if c != "text"]
    bits = model.weights.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            sums, letters = np.zeros((batch.num_rows, bits), np.int64), np.zeros(batch.num_rows, np.int64)
            for grams, data, rows, first, end in _windows(batch, VALUES // max(bits, 1)):
                letters[rows] += _summed((data != 32).astype(np.int8), first, end)
                if bits:
                    total = table[grams[0]].astype(np.int32)
                    for more in grams[1:]:
                        total += table[more]
                    sums[rows] += _summed(total, first, end)
            offsets = pa.array(np.arange(batch.num_rows + 1) * bits, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(letters), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))],
                [*columns, "letters", "margins"],
            )

    kept = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns)
    return texts.mapInArrow(score, f"{kept}, letters long, margins array<long>")


def calibrated(tested: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, threshold and weight of each bit from ``tested`` (label, letters, margins). A bit with nothing to go
    by has slope 1 and threshold 0."""
    bits = model.code.shape[1]
    slope, middle = np.ones(bits), np.zeros(bits)
    mean = (F.col("margin") / SCALE).cast("double")
    each = tested.where(F.col("label").isin(model.languages)).select(
        "label", "letters", F.posexplode("margins").alias("bit", "margin")
    )
    moments = each.groupBy("label", "bit").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("letters").alias("letters"),
        F.sum(mean).alias("total"),
        F.sum(mean * mean / F.col("letters")).alias("square"),
    )
    found = {(r["label"], r["bit"]): r for r in moments.collect()}
    for k in range(bits):
        rows = [(model.code[at, k], found[x, k]) for at, x in enumerate(model.languages) if (x, k) in found]
        sides = [[r["total"] / r["letters"] for bit, r in rows if bit == side] for side in (0, 1)]
        spread, n = sum(r["square"] - r["total"] ** 2 / r["letters"] for _, r in rows), sum(r["n"] for _, r in rows)
        if all(sides) and spread > 0:
            low, high = map(np.mean, sides)
            if high > low:
                slope[k], middle[k] = (high - low) / (spread / n), (low + high) / 2
    slope, middle = np.round(slope, 6), np.round(middle, 6)
    right = (F.get(_bits_of(model, F.col("label")), F.col("bit")) == 1) == (_logit(slope, middle, "bit", "margin") > 0)
    votes = {r["bit"]: r for r in each.groupBy("bit").agg(F.count_if(~right).alias("wrong"), F.count(F.lit(1)).alias("n")).collect()}
    weight = np.ones(bits)
    for k, r in votes.items():
        error = (r["wrong"] + 1) / (r["n"] + 2)
        weight[k] = max(0.0, np.log((1 - error) / error))
    if weight.sum() == 0:
        weight[:] = 1
    return slope, middle, np.round(weight * bits / weight.sum(), 6)


def _bits_of(model: Model, label: Column) -> Column:
    rows = F.array(*(_literal(row) for row in model.code))
    return F.get(rows, F.array_position(F.lit(model.languages), label).cast("int") - 1)


def _logit(slope: np.ndarray, middle: np.ndarray, bit: str | Column, margin: str | Column) -> Column:
    """Log-odds that a bit is set: the mean weight of the text's n-grams, its distance from the threshold
    counting more the longer the text."""
    margin = F.col(margin) if isinstance(margin, str) else margin
    letters = F.col("letters")
    return F.get(_literal(slope, "double"), bit) * (margin / SCALE - F.get(_literal(middle, "double"), bit) * letters)


def decoded(scored: DataFrame, model: Model, slope: np.ndarray, middle: np.ndarray, weight: np.ndarray) -> DataFrame:
    """``lang_pred``, ``score``, ``ambiguous`` and ``wrong_bits`` from the margins."""
    logits = F.transform("margins", lambda m, k: _logit(slope, middle, k, m))
    known = scored.withColumn("_logits", logits)

    def loss(word: Column) -> Column:
        def term(x: Column, k: Column) -> Column:
            against = F.when(F.get(word, k) == 1, -x).otherwise(x)
            # log(1 + exp(a)), safe for large a.
            soft = F.greatest(against, F.lit(0.0)) + F.log1p(F.exp(-F.abs(against)))
            return F.get(_literal(weight, "double"), k) * soft

        return F.aggregate(F.transform("_logits", term), F.lit(0.0), lambda a, x: a + x)

    words = F.array(*(F.struct(F.lit(x).alias("lang"), _literal(w).alias("word")) for x, w in zip(model.languages, model.code, strict=True)))
    losses = F.array_sort(F.transform(words, lambda w: F.struct(loss(w["word"]).alias("loss"), w["lang"].alias("lang"), w["word"].alias("word"))))
    # Each array stands in a one-row array, so that it is computed once however often it is used.
    best = F.transform(
        F.array(losses),
        lambda all_: F.struct(
            all_[0]["lang"].alias("lang"),
            (1 / F.aggregate(all_, F.lit(0.0), lambda a, x: a + F.exp(all_[0]["loss"] - x["loss"]))).alias("score"),
            F.size(F.filter(F.zip_with("_logits", all_[0]["word"], lambda x, b: (x > 0) != (b == 1)), lambda x: x)).alias("wrong"),
        ),
    )[0]
    radius = max(0, (distance(model.code) - 1) // 2)
    unclear = (F.col("_best.score") < SURE) | (F.col("_best.wrong") > radius)
    return known.withColumn("_best", F.when(F.col("letter"), best)).select(
        *(c for c in scored.columns if c not in ("margins", "letters", "letter")),
        F.coalesce("_best.lang", F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(F.round("_best.score", 6), F.lit(0.0)).alias("score"),
        F.coalesce(unclear, F.lit(True)).alias("ambiguous"),
        F.col("_best.wrong").alias("wrong_bits"),
    )


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Id, whether it is held out, the label if it may be learned, its quarter of the learning part, and the padded text."""
    dealt = F.crc32(docs[doc_id].cast("string").cast("binary"))
    letter = whole(docs[text]).rlike(r"\p{L}")
    held_out = F.coalesce(dealt % PARTS == HELD_OUT, F.lit(False))
    return docs.select(
        docs[doc_id].alias("doc_id"),
        held_out.alias("held_out"),
        letter.alias("letter"),
        F.when(letter & (dealt % PARTS != HELD_OUT), docs[lang].cast("string")).alias("label"),
        F.floor(dealt / PARTS % PARTS).cast("int").alias("quarter"),
        F.concat(F.lit(" "), F.lower(whole(docs[text])), F.lit(" " * PAD)).alias("text"),
    )


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous`` and ``wrong_bits``, a row per document."""
    ship_code(docs.sparkSession)
    texts = prepared(docs, doc_id, text, lang)
    given = F.col("label").isNotNull()
    counted = given & (F.col("quarter") != 0)
    model = learned(texts.where(counted))
    if not model.languages:
        # So few labels that all are in the quarter for calibration.
        model = learned(texts.where(given))
    if not model.languages:
        scored = texts.select("doc_id", "held_out")
        return scored.withColumns(
            {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(True), "wrong_bits": F.lit(None).cast("int")}
        )
    scored = cut(margins(texts, model), "language_margins")
    tested = scored.where(given & (F.col("quarter") == 0) & (F.col("letters") > 0))
    slope, middle, weight = calibrated(tested, model)
    return decoded(scored.drop("label", "quarter"), model, slope, middle, weight)
