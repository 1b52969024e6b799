"""MinHash of word shingles, many texts at once.

A text's words (ASCII lower case, split at the six white-space characters) are hashed from running sums over the
bytes, its shingles from the words, and the least values of each of ``BANDS * BAND`` permutations by one pass over
all shingles of a slice. ``bands`` holds one hash per band, ``sketch`` the lowest four bits of every value, 16 values
to a number: two texts of similarity s differ in about (1 - s) * 15 / 16 of the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import ship_code, whole

SHINGLE = 5
BANDS, BAND = 40, 6
NIBBLES = 16  # values in a number of the sketch
SLICE = 1 << 18  # bytes of text hashed at once
VALUES = BANDS * BAND
SIGNED = "doc_id long, bands array<long>, sketch array<long>"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no order."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_DRAW = np.random.default_rng(1)
_FACTORS = _DRAW.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    folded = _FOLD[data]
    edge = np.diff(np.concatenate(([0], (folded != 32).astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    factor = np.full(len(data) + 1, _ODD)
    factor[0] = 1
    back = np.full(len(data) + 1, _INVERSE)
    back[0] = 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[folded] * np.cumprod(factor)[:-1])))
    return mixed((total[end] - total[begin]) * np.cumprod(back)[begin] + (end - begin).astype(np.uint64)), begin


def shingles(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``SHINGLE`` words of each row, of all its words if it has fewer, and their rows."""

    def joined(first: np.ndarray, count: int) -> np.ndarray:
        out = np.full(len(first), count, np.uint64)
        for k in range(count):
            out = out * _ODD + words[first + k]
        return mixed(out)

    at = np.arange(max(len(words) - SHINGLE + 1, 0))
    at = at[row[at] == row[at + SHINGLE - 1]]
    hashes, rows = [joined(at, SHINGLE)], [row[at]]
    held, first, count = np.unique(row, return_index=True, return_counts=True)
    for n in range(1, SHINGLE):
        few = count == n
        if few.any():
            hashes.append(joined(first[few], n))
            rows.append(held[few])
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def least_values(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order, and the least value of every permutation over each row's hashes."""
    if not len(rows):
        return rows, np.zeros((0, VALUES), np.uint32)
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    out = np.empty((len(first), VALUES), np.uint32)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(hashes * _FACTORS[k] + _SHIFTS[k], first) >> np.uint64(32)
    return rows[first], out


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``SLICE`` bytes."""
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE, "right")) - 1)
        yield low, high
        low = high


def _long_text(data: np.ndarray) -> np.ndarray | None:
    """Least values of one text, taken in pieces that overlap by all but one word of a shingle."""
    low, least, words = 0, None, np.zeros(0, np.uint64)
    while low < len(data):
        spaces = np.flatnonzero(_FOLD[data[low + SLICE : low + 2 * SLICE]] == 32)
        high = low + SLICE + int(spaces[0]) if len(spaces) else len(data) if low + 2 * SLICE >= len(data) else None
        if high is None:
            # A word longer than a slice: up to its end.
            rest = np.flatnonzero(_FOLD[data[low + 2 * SLICE :]] == 32)
            high = low + 2 * SLICE + int(rest[0]) if len(rest) else len(data)
        words = np.concatenate((words[-(SHINGLE - 1) :], word_hashes(data[low:high])[0]))
        low = high
        if len(words) >= SHINGLE or (low >= len(data) and least is None and len(words)):
            _, value = least_values(*shingles(words, np.zeros(len(words), np.int64)))
            least = value if least is None else np.minimum(least, value)
    return least


def signatures(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a word, and their least values. Every text ends in a space."""
    rows, values = [np.zeros(0, np.int64)], [np.zeros((0, VALUES), np.uint32)]
    for low, high in _slices(ends):
        text = data[ends[low] : ends[high]]
        if len(text) > 2 * SLICE:
            found = _long_text(text)
            if found is not None:
                rows.append(np.array([low]))
                values.append(found)
            continue
        words, begin = word_hashes(text)
        row = np.searchsorted(ends[low : high + 1] - ends[low], begin, "right") - 1 + low
        held, least = least_values(*shingles(words, row))
        rows.append(held)
        values.append(least)
    return np.concatenate(rows), np.concatenate(values)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factor = np.cumprod(np.full(BAND, _ODD))
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        _, ends, data = text.buffers()
        ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
        rows, values = signatures(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends)
        banded = mixed((values.reshape(-1, BANDS, BAND).astype(np.uint64) * factor).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        low = (values & np.uint32(15)).astype(np.uint64).reshape(len(rows), VALUES // NIBBLES, NIBBLES)
        sketch = (low << (np.arange(NIBBLES, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)

        def lists(numbers: np.ndarray) -> pa.Array:
            width = numbers.shape[1]
            return pa.ListArray.from_arrays(
                pa.array(np.arange(len(numbers) + 1) * width, pa.int32()), pa.array(numbers.view(np.int64).ravel())
            )

        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(rows)), lists(banded), lists(sketch)], ["doc_id", "bands", "sketch"]
        )


def signed(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``doc_id``, ``bands`` and ``sketch`` of each text that has a word."""
    ship_code(docs.sparkSession)
    ended = docs.select(doc_id.cast("long").alias("doc_id"), F.concat(whole(text), F.lit(" ")).alias("text"))
    return ended.mapInArrow(_sign, SIGNED)


def sketch_distance(a: Column, b: Column) -> Column:
    """Values in which two sketches differ."""

    def differing(k: int) -> Column:
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111).cast("long")))

    words = [differing(k) for k in range(VALUES // NIBBLES)]
    return sum(words[1:], words[0])
