"""SentencePiece encoding and decoding with a published piece table.

Text becomes units: a space is written as U+2581, one is put in front, and a unit starts at each run of
them. No piece of the table has that sign after another character, so no piece crosses units.

Relational lattice: units explode into bounded-length substrings, an equi-join with the piece table leaves
the lattice's edges, edges are grouped by unit and a higher-order aggregate folds them. The given table is
a merge table (its scores are merge ranks), for which the best-scoring path is not the library's result;
the fold therefore takes, step after step, the best-ranked edge that joins two neighbours, leftmost first.
Characters outside the table become their UTF-8 bytes.

Documents: the most frequent units of the corpus, counted over all documents, are encoded by the lattice
once; that dictionary has at most ``dictionary_units`` rows and goes to every task. Units beyond it are
rare ones; joining them back would move every word of the corpus, so a task folds those it meets by the
same rule. The dictionary's length changes the time taken, never the ids.

Defined results: NULL and empty text have no ids and decode to the empty text. A U+2581 in a text is a
space to the table, as it is to the library, and decodes to one. Rows that repeat have a row each.
Columns already named ``ids`` or ``decoded`` are replaced. No rows in, no rows out.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from tablesync.llm.common import cut, indices, ship_code, whole

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SIGN = "▁"
UNIT = f"{SIGN}*[^{SIGN}]+|{SIGN}+"
DICTIONARY_UNITS = 1 << 17
DICTIONARY_CHARS = 24
TASK_CACHE = 1 << 16
SHORT_UNIT = 128
SLICE_ROWS = 256
BATCH_ROWS = 1024


def piece_table(model: str = MODEL) -> list[tuple[str, int, float]]:
    """(piece, id, rank) of all pieces that text can match; a smaller rank merges first."""
    import sentencepiece

    table = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(table.get_piece_size())
    return [
        (table.id_to_piece(i), i, -table.get_score(i))
        for i in ids
        if not (table.is_byte(i) or table.is_control(i) or table.is_unknown(i) or table.is_unused(i))
    ]


def first_byte(model: str = MODEL) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model).piece_to_id("<0x00>")


def encode_units(units: DataFrame, model: str = MODEL) -> DataFrame:
    """``unit``, ``ids`` of each distinct value in ``units`` (unit), by the relational lattice."""
    spark = units.sparkSession
    pieces = piece_table(model)
    most = max(len(p) for p, _, _ in pieces)
    # The piece table is as large as the vocabulary file, whatever the corpus.
    table = F.broadcast(spark.createDataFrame(pieces, "piece string, id int, rank double"))
    starts = units.select("unit", F.length("unit").alias("n")).distinct().select(
        "unit", "n", F.explode(indices(F.col("n"))).alias("s")
    )
    spans = starts.select(
        "unit", "n", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("n"), F.col("s") + most))).alias("e")
    )
    edges = spans.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("e") - F.col("s"))).join(
        table, "piece", "left"
    )
    lattice = edges.groupBy("unit", "n").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("id").isNotNull(), F.struct("rank", "s", "e", "id")))
        ).alias("edges")
    )

    # after[i] is the end of the piece that starts at i, -1 where none does.
    def merge(after: Column, _: Column) -> Column:
        fits = F.filter("edges", lambda x: F.get(after, F.get(after, x["s"])) == x["e"])
        return F.transform(
            F.array(F.get(fits, 0)),
            lambda best: F.when(best.isNull(), after).otherwise(
                F.transform(
                    after,
                    lambda end, i: F.when(i == best["s"], best["e"])
                    .when(i == F.get(after, best["s"]), F.lit(-1))
                    .otherwise(end),
                )
            ),
        )[0]

    ends = F.aggregate(indices(F.col("n")), F.transform(indices(F.col("n")), lambda i: i + 1), merge)
    base = first_byte(model)

    def fallback(char: Column) -> Column:
        digits = F.hex(F.encode(char, "UTF-8"))
        return F.transform(
            indices((F.length(digits) / 2).cast("int")),
            lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + base,
        )

    def ids(i: Column) -> Column:
        known = F.get(F.filter("edges", lambda x: (x["s"] == i) & (x["e"] == F.get("after", i))), 0)["id"]
        return F.when(known.isNotNull(), F.array(known)).otherwise(fallback(F.substring("unit", i + 1, F.lit(1))))

    folded = lattice.withColumn("after", ends)
    begins = F.filter(indices(F.col("n")), lambda i: F.get("after", i) > 0)
    return folded.select("unit", F.flatten(F.transform(begins, ids)).alias("ids"))


def frequent_units(docs: DataFrame, text: str, limit: int, chars: int = DICTIONARY_CHARS) -> DataFrame:
    """The ``limit`` most frequent words of all documents, as units of at most ``chars`` code points."""
    words = docs.select(F.explode(F.split(whole(docs[text]), " ")).alias("word")).where(
        (F.col("word") != "") & (F.length("word") < chars) & ~F.contains("word", F.lit(SIGN))
    )
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(limit).select(F.concat(F.lit(SIGN), "word").alias("unit"))


class Fold(dict):
    """Ids of units as packed 32-bit numbers; a unit that isn't there is folded when asked for."""

    def __init__(self, known: dict[str, bytes], pieces: dict[str, tuple[float, int]], base: int):
        super().__init__(known)
        self.n_known, self.base = len(known), base
        self.ids = {p: i for p, (_, i) in pieces.items()}
        self.rank = {p: rank for p, (rank, _) in pieces.items()}.get
        self.most = max(map(len, pieces))

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.n_known + TASK_CACHE:
            while len(self) > self.n_known:
                self.popitem()  # the newest first: the dictionary stays
        packed = np.array(self.fold(unit), dtype="<i4").tobytes()
        if len(unit) <= DICTIONARY_CHARS:
            self[unit] = packed
        return packed

    def fold(self, unit: str) -> list[int]:
        ids: list[int] = []
        for piece in self.parts(unit) if len(unit) <= SHORT_UNIT else self.long_parts(unit):
            if piece in self.ids:
                ids.append(self.ids[piece])
            else:
                ids += (self.base + b for b in piece.encode())
        return ids

    def parts(self, unit: str) -> list[str]:
        """Join the best-ranked pair of neighbours until no pair is a piece; for short units."""
        rank, never = self.rank, math.inf
        parts = list(unit)
        pairs = [rank(unit[i : i + 2], never) for i in range(len(parts) - 1)]
        while pairs and (best := min(pairs)) != never:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def long_parts(self, unit: str) -> list[str]:
        """The same with an agenda: n log n in the length of the unit."""
        n, rank, most = len(unit), self.rank, self.most
        after, before = list(range(1, n + 1)), list(range(-1, n))
        agenda: list[tuple[float, int, int, int]] = []

        def offer(start: int, middle: int) -> None:
            end = after[middle]
            if end - start <= most and (found := rank(unit[start:end])) is not None:
                heapq.heappush(agenda, (found, start, middle, end))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, start, middle, end = heapq.heappop(agenda)
            if after[start] != middle or after[middle] != end:
                continue
            after[start], after[middle] = end, -1
            if end < n:
                before[end] = start
                offer(start, end)
            if start:
                offer(before[start], start)
        return [unit[i : after[i]] for i in range(n) if after[i] > 0]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``. Whole texts in batches of Spark's 10,000 rows are tens
    of MB, held by the JVM and the worker of every running task at once. Batches never change results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


Step = tuple[str, DataType, str, Callable[[pa.Array], pa.Array]]


def _with_columns(df: DataFrame, steps: list[Step], gone: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns (name, type, input column, function) made in order, a slice of rows at a time;
    columns in ``gone`` go, the others pass as they are."""
    ship_code(df.sparkSession)
    small_batches(df.sparkSession)
    made = {name for name, *_ in steps}
    kept = [f for f in df.schema.fields if f.name not in made]
    out = StructType([*(f for f in kept if f.name not in gone), *(StructField(n, t) for n, t, *_ in steps)])
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                columns = {f.name: part.column(f.name) for f in kept}
                for name, _, source, step in steps:
                    columns[name] = step(columns[source])
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)
            # Else this batch is held while the next one comes in.
            batch = part = columns = None

    return df.mapInArrow(run, out)


def _encoder(docs: DataFrame, text: str, model: str, dictionary_units: int) -> Step:
    words = cut(encode_units(cut(frequent_units(docs, text, dictionary_units), "units"), model), "dictionary")
    known = {
        r["unit"]: np.array(r["ids"], dtype="<i4").tobytes() for r in words.toLocalIterator(prefetchPartitions=True)
    }
    pieces = {p: (rank, i) for p, i, rank in piece_table(model)}
    shared = docs.sparkSession.sparkContext.broadcast((known, pieces, first_byte(model)))
    number, find = shared._jbroadcast.id(), re.compile(UNIT).findall

    def step(texts: pa.Array) -> pa.Array:
        fold = _task_fold(number, shared)
        packed = [
            b"".join(map(fold.__getitem__, find(SIGN + t.replace(" ", SIGN)))) if t else b"" for t in texts.to_pylist()
        ]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
        values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return "ids", ArrayType(IntegerType(), containsNull=False), text, step


def _decoder(ids: str, name: str, model: str) -> Step:
    import sentencepiece

    table = sentencepiece.SentencePieceProcessor(model_file=model)
    base = first_byte(model)
    spelled = [
        bytes([i - base])
        if table.is_byte(i)
        else b""
        if table.is_control(i) or table.is_unknown(i)
        else table.id_to_piece(i).replace(SIGN, " ").encode()
        for i in range(table.get_piece_size())
    ]

    def step(rows: pa.Array) -> pa.Array:
        texts = []
        for ids in rows:
            found = [] if ids.values is None else ids.values.to_numpy(zero_copy_only=False).tolist()
            text = b"".join([spelled[i] for i in found])
            texts.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
        return pa.array(texts, pa.string())

    return name, StringType(), ids, step


def encode(
    docs: DataFrame, text: str = "text", model: str = MODEL, dictionary_units: int = DICTIONARY_UNITS
) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of the whole text."""
    return _with_columns(docs, [_encoder(docs, text, model, dictionary_units)])


def decode(docs: DataFrame, ids: str = "ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with ``name``, the text that the ids spell. Bytes that are no UTF-8 become U+FFFD."""
    return _with_columns(docs, [_decoder(ids, name, model)])


def round_trip(
    docs: DataFrame, text: str = "text", model: str = MODEL, dictionary_units: int = DICTIONARY_UNITS
) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` instead of the text, in one pass."""
    steps = [_encoder(docs, text, model, dictionary_units), _decoder("ids", "decoded", model)]
    return _with_columns(docs, steps, gone=(text,))


_FOLDS: dict[int, Fold] = {}


def _task_fold(number: int, shared) -> Fold:
    """One dictionary per Python worker, kept from task to task of the same query."""
    if number not in _FOLDS:
        _FOLDS.clear()
        _FOLDS[number] = Fold(*shared.value)
    return _FOLDS[number]
