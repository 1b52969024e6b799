"""Exact-substring dedup: repeated strings of ``LENGTH`` bytes found from a sorted sample of suffixes.

Every suffix of ``LENGTH`` bytes belongs to its anchor, the ``GRAM``-byte string inside it with the smallest
hash; equal suffixes have equal anchors at equal places. Neighbouring suffixes with one anchor form a run.

1. Sorting the sample: tuples (anchor, run, document, place), one per run and not per byte, are dealt to
   buckets by anchor and sorted there. Runs that are equal as a whole, each with a common prefix that long,
   are decided here: the smallest document keeps them. A task first combines equal runs it holds itself, so
   a passage in very many documents reaches a bucket once per task.
2. Induction: runs with a common anchor that differ are the ends of matches. Their few dozen bytes are
   fetched, their suffixes sorted within the anchor, and neighbours with a common prefix of ``LENGTH`` decided.
   An anchor with more than ``HOT`` such runs is split: its suffixes are dealt by their own hash, the smallest
   document of each is found by a combining aggregation and joined back, so no group grows with an anchor.
3. Decided suffixes become byte ranges per document; their union is removed.

Sorts are Spark's shuffle plus an in-memory sort of one bucket, whose size is set by the input.

Defined results: NULL is the empty text. Texts under ``LENGTH`` bytes lose nothing. A NULL id is smaller
than every other. Documents with equal ids never remove bytes from each other; rows that repeat id and text
have equal results. Other columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import cut, numbered, ship_code, whole

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
RUN = 32
CHUNK_BYTES = 1 << 20
COMBINE_BYTES = 1 << 23
BUCKET_BYTES = 1 << 23  # text bytes per bucket; a bucket's tuples take about as many
HOT = 1 << 15  # runs to compare with one anchor, beyond which they are dealt by suffix
NO_ID = -(1 << 63)

_MULTIPLIER = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no order."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def substring_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all substrings of each size, by start, from hashes of powers of two."""
    powers = {1: _BYTES[data]}
    factor = {1: _MULTIPLIER}
    step = 1
    while 2 * step <= max(sizes):
        have = powers[step]
        cut_at = max(len(have) - step, 0)
        powers[2 * step] = have[:cut_at] * np.uint64(factor[step]) + have[step:]
        factor[2 * step] = factor[step] ** 2 % 2**64
        step *= 2
    out = []
    for size in sizes:
        left, at, total = size, 0, None
        for power in sorted(powers, reverse=True):
            if power <= left:
                count = max(len(data) - size + 1, 0)
                part = powers[power][at : at + count]
                total = part if total is None else total * np.uint64(factor[power]) + part
                left, at = left - power, at + power
        out.append(_mixed(total))
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have, step = values, 1
    while 2 * step <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    count = len(values) - width + 1
    return np.minimum(have[:count], have[width - step : width - step + count])


def runs_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one text's bytes: anchor, hash of the run, first suffix, number of suffixes."""
    grams, suffixes = substring_hashes(data, (GRAM, LENGTH))
    anchors = _smallest(grams, WINDOW)
    change = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
    starts = np.concatenate(([0], change))
    lengths = np.diff(np.append(starts, len(anchors)))
    # A repetitive stretch has one anchor throughout; its run is taken in pieces.
    pieces = -(-lengths // RUN)
    first = np.repeat(starts, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(np.repeat(starts + lengths, pieces) - first, RUN)
    key = anchors[first]
    run = _mixed(suffixes[first] * np.uint64(3) + _mixed(suffixes[first + size - 1] + key) + size.astype(np.uint64))
    return key, run, first, size


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), ends


def _six(values: np.ndarray) -> bytes:
    """The low six bytes of each number; the bucket tells the rest."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


PACKED = "bucket int, uids binary, ids binary, counts binary, anchors binary, runs binary, firsts binary, sizes binary"


def _sampler(buckets: int):
    def pack(bucket, uid, cmp, rows, anchor, run, first, size, plain):
        """One row of packed tuples; ``rows`` is each tuple's document, ascending."""
        docs, counts = np.unique(rows, return_counts=True)
        return (
            int(bucket), uid[docs].tobytes(), cmp[docs].tobytes(), counts.astype("<i4").tobytes(),
            b"" if plain else _six(anchor), b"" if plain else _six(run),
            first.astype("<i4").tobytes(), size.astype("u1").tobytes(),
        )

    def combined(uid, cmp, parts) -> Iterator[tuple]:
        rows, anchor, run, first, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Rows come in order of id, so a stable sort by run puts the smallest document first.
        order = np.argsort(run, kind="stable")
        new = np.append(True, (run[order][1:] != run[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))
        leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        known = np.zeros(len(rows), bool)
        known[order] = cmp[rows[order]] > cmp[rows[leader]]
        bucket = np.where(
            known, buckets + (_mixed(uid[rows].view(np.uint64)) % np.uint64(buckets)).astype(np.int64),
            ((anchor >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64),
        )
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                b = bucket[part[0]]
                yield pack(b, uid, cmp, rows[part], anchor[part], run[part], first[part], size[part], b >= buckets)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int32() if n == "bucket" else pa.binary()) for n in _names(PACKED)])
        for batch in batches:
            data, ends = _text_bytes(batch.column("text"))
            uid, cmp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "id"))
            by_id = np.argsort(cmp, kind="stable")
            uid, cmp = uid[by_id], cmp[by_id]
            parts, held = [], 0
            for row, i in enumerate(by_id):
                text = data[ends[i] : ends[i + 1]]
                for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK_BYTES):
                    key, run, first, size = runs_of(text[at : at + CHUNK_BYTES + LENGTH - 1])
                    parts.append((np.full(len(key), row), key, run, first + at, size))
                held += len(text)
                if held >= COMBINE_BYTES:
                    yield _batch(combined(uid, cmp, parts), schema)
                    parts, held = [], 0
            if parts:
                yield _batch(combined(uid, cmp, parts), schema)

    return sample


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _batch(rows: Iterator[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


DECIDED = "uid long, id long, first int, size int, anchor long"


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of one bucket: removed ones (anchor NULL), and those whose suffixes must be compared."""
    read = lambda column, kind: np.frombuffer(b"".join(pdf[column]), kind)
    counts = read("counts", "<i4")
    uid, cmp = np.repeat(read("uids", "<i8"), counts), np.repeat(read("ids", "<i8"), counts)
    first, size = read("firsts", "<i4"), read("sizes", "u1").astype(np.int32)
    anchor, run = _from_six(b"".join(pdf["anchors"])), _from_six(b"".join(pdf["runs"]))
    if not len(anchor):  # runs that a task has decided itself
        return _decided(uid, cmp, first, size, None)
    order = np.lexsort((cmp, run, anchor))
    uid, cmp, first, size, anchor, run = (x[order] for x in (uid, cmp, first, size, anchor, run))
    index = np.arange(len(order))
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    new_run = new_anchor | np.append(True, run[1:] != run[:-1])
    leader = np.maximum.accumulate(np.where(new_run, index, 0))
    gone = cmp > cmp[leader]
    # An anchor's runs that stay, of more than one document, may share suffixes.
    group = np.cumsum(new_anchor) - 1
    low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, group[~gone], cmp[~gone])
    np.maximum.at(high, group[~gone], cmp[~gone])
    ask = ~gone & (low < high)[group]
    return pd.concat(
        [
            _decided(uid[gone], cmp[gone], first[gone], size[gone], None),
            _decided(uid[ask], cmp[ask], first[ask], size[ask], anchor[ask]),
        ]
    )


def _decided(uid, cmp, first, size, anchor) -> pd.DataFrame:
    held = pd.array([None] * len(uid) if anchor is None else anchor.view(np.int64), dtype="Int64")
    return pd.DataFrame({"uid": uid, "id": cmp, "first": first, "size": size, "anchor": held})


FETCHED = "bucket int, uid long, id long, first int, size int, anchor long, piece binary"


def _fetcher(buckets: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FETCHED.split(", ")])
        for batch in batches:
            rows = []
            texts, uids, ids, asked = (batch.column(c) for c in ("text", "uid", "id", "asked"))
            for i in range(batch.num_rows):
                text = texts[i].as_py().encode()
                uid, cmp = uids[i].as_py(), ids[i].as_py()
                for x in asked[i].as_py():
                    first, size, anchor = x["first"], x["size"], x["anchor"]
                    rows.append((anchor % buckets, uid, cmp, first, size, anchor, text[first : first + size + LENGTH - 1]))
            yield _batch(iter(rows), schema)

    return fetch


RANGES = "uid long, first int, size int"


def _induce(pdf: pd.DataFrame) -> pd.DataFrame:
    """Suffixes of runs with a common anchor, sorted: those that a smaller document has too."""
    size = pdf["size"].to_numpy(np.int64)
    data = np.frombuffer(b"".join(pdf["piece"]), np.uint8)
    begin = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    row = np.repeat(np.arange(len(pdf)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    (hashes,) = substring_hashes(data, (LENGTH,))
    suffix = hashes[begin[row] + place]
    cmp, anchor = pdf["id"].to_numpy(np.int64)[row], pdf["anchor"].to_numpy(np.int64)[row]
    order = np.lexsort((cmp, suffix, anchor))
    new = np.append(True, (suffix[order][1:] != suffix[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))
    leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    gone = np.zeros(len(row), bool)
    gone[order] = cmp[order] > cmp[leader]
    at = np.flatnonzero(gone)
    starts = at[np.append(True, (np.diff(at) > 1) | (row[at][1:] != row[at][:-1]))[: len(at)]] if len(at) else at
    ends = at[np.append((np.diff(at) > 1) | (row[at][1:] != row[at][:-1]), True)[: len(at)]] if len(at) else at
    return pd.DataFrame(
        {
            "uid": pdf["uid"].to_numpy(np.int64)[row[starts]],
            "first": (pdf["first"].to_numpy(np.int64)[row[starts]] + place[starts]).astype(np.int32),
            "size": (ends - starts + 1).astype(np.int32),
        }
    )


SUFFIXES = "uid long, id long, anchor long, place int, suffix long"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per suffix of the runs asked for."""
    schema = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("anchor", pa.int64()), ("place", pa.int32()), ("suffix", pa.int64())])
    for batch in batches:
        texts, uids, ids, asked = (batch.column(c) for c in ("text", "uid", "id", "asked"))
        for i in range(batch.num_rows):
            text = np.frombuffer(texts[i].as_py().encode(), np.uint8)
            parts = []
            for x in asked[i].as_py():
                first, size, anchor = x["first"], x["size"], x["anchor"]
                (hashes,) = substring_hashes(text[first : first + size + LENGTH - 1], (LENGTH,))
                parts.append((np.full(size, anchor), np.arange(first, first + size), hashes.view(np.int64)))
            anchor, place, suffix = (np.concatenate(x) for x in zip(*parts, strict=True))
            who = [np.full(len(place), v, np.int64) for v in (uids[i].as_py(), ids[i].as_py())]
            columns = [*who, anchor, place.astype(np.int32), suffix]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _asked(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.col("uid").alias("a_uid")).agg(F.collect_list(F.struct("first", "size", "anchor")).alias("asked"))


def _by_suffix(known: DataFrame, runs: DataFrame) -> DataFrame:
    """Ranges of the suffixes of ``runs`` that a smaller document has too, dealt by suffix."""
    joined = known.join(_asked(runs), F.col("uid") == F.col("a_uid")).select(*known.columns, "asked")
    rows = cut(joined.mapInArrow(_suffixes, SUFFIXES), "hot_suffixes")
    least = rows.groupBy("anchor", "suffix").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    gone = rows.join(least, ["anchor", "suffix"]).where("id > least")
    return gone.select("uid", F.col("place").alias("first"), F.lit(1).alias("size"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = _text_bytes(batch.column("text"))
        spans, kept = [], []
        for i, ranges in enumerate(batch.column("ranges")):
            text = data[ends[i] : ends[i + 1]]
            edge = np.zeros(len(text) + 1, np.int32)
            if ranges.values is not None:
                first = ranges.values.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
                size = ranges.values.field("size").to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + size + LENGTH - 1, -1)
            gone = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False])).astype(np.int8)
            turns = np.flatnonzero(np.diff(gone))
            spans.append([{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)])
            kept.append(text[gone[1:-1] == 0].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_bytes", "removed", "kept"],
        )


def _identified(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """doc_id, text, id (NULL as the smallest number) and uid: the id where it is unique, else a number
    of its own for every id and text."""
    plain = docs.select(doc_id.cast("long").alias("doc_id"), whole(text).alias("text")).withColumn(
        "id", F.coalesce("doc_id", F.lit(NO_ID))
    )
    counts = plain.agg(F.count("*"), F.count_distinct("id")).first()
    if counts[0] == counts[1]:
        return plain.withColumn("uid", F.col("id"))
    keyed = plain.withColumn("row", F.xxhash64("text"))
    numbers = cut(
        numbered(keyed.select("id", "row").distinct(), F.col("id"), F.col("row"), name="uid"), "document_numbers"
    )
    return keyed.join(numbers, ["id", "row"]).drop("row")


def repeated_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, removed (array of start, end in bytes), kept (the other bytes)."""
    ship_code(docs.sparkSession)
    known = _identified(docs, docs[doc_id], docs[text])
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total // BUCKET_BYTES)
    packed = known.select("uid", "id", "text").mapInArrow(_sampler(buckets), PACKED)
    decided = cut(packed.groupBy("bucket").applyInPandas(_decide, DECIDED), "runs")
    asked = decided.where("anchor IS NOT NULL")
    # At most one anchor in HOT runs.
    hot = cut(asked.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor"), "hot_anchors")
    split = not hot.isEmpty()
    fetched = (
        known.join(_asked(asked.join(hot, "anchor", "left_anti") if split else asked), F.col("uid") == F.col("a_uid"))
        .select(*known.columns, "asked")
        .mapInArrow(_fetcher(buckets), FETCHED)
    )
    # Both joins take the same columns of the documents, so that one exchange of the texts serves both.
    induced = fetched.groupBy("bucket").applyInPandas(_induce, RANGES)
    if split:
        induced = induced.unionByName(_by_suffix(known, asked.join(hot, "anchor", "left_semi")))
    ranges = (
        decided.where("anchor IS NULL").select("uid", "first", "size").unionByName(induced)
        .groupBy(F.col("uid").alias("r_uid"))
        .agg(F.collect_list(F.struct("first", "size")).alias("ranges"))
    )
    return (
        known.join(ranges, F.col("uid") == F.col("r_uid"), "left")
        .select(*known.columns, "ranges")
        .mapInArrow(_remove, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
    )
