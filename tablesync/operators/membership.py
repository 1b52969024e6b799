"""Membership sketches: which stored parts may hold a key, without reading their keys.

A sketch is a blocked bit set: a key's hash names one 64-bit word and four bits in it. Held as rows (width, word,
bits), it is built by one combining aggregation, merged by OR, and asked by an equi-join. It never misses a key
that it has seen; at ``BITS_PER_KEY`` about one foreign key in a hundred passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
LEAST_WORDS = 1 << 10
_WORD = 64
_SET = 4


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def words_for(n_keys: int) -> int:
    """A power of two, so that parts of like size have sketches of one width."""
    least = max(LEAST_WORDS, -(-n_keys * BITS_PER_KEY // _WORD))
    return 1 << (least - 1).bit_length()


def _mask(keys: Sequence[str]) -> Column:
    spread = F.xxhash64(F.lit("bits"), *keys)
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(_WORD - 1)).cast("int"))
        for i in range(_SET)
    ]
    return reduce(Column.bitwiseOR, bits)


def sketch(df: DataFrame, keys: Sequence[str], words: int) -> DataFrame:
    """``word`` and ``bits`` of the words in use; map-side combining leaves at most ``words`` rows per task."""
    placed = df.select(F.pmod(key_hash(keys), F.lit(words)).alias("word"), _mask(keys).alias("bits"))
    return placed.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def possibly_held(df: DataFrame, keys: Sequence[str], sketches: DataFrame, widths: Sequence[int], part: str) -> DataFrame:
    """``key_hash`` and ``part`` for each key of ``df`` and each part whose sketch (``part``, width, word, bits) may
    hold it. ``widths`` are those that occur."""
    hashed = key_hash(keys)
    places = F.array(*(F.struct(F.lit(w).cast("long").alias("width"), F.pmod(hashed, F.lit(w)).alias("word")) for w in widths))
    asked = df.select(hashed.alias("key_hash"), _mask(keys).alias("mask"), F.explode(places).alias("place"))
    asked = asked.select("key_hash", "mask", "place.*")
    held = sketches.select(part, F.col("width").cast("long").alias("width"), "word", "bits")
    found = asked.join(held, ["width", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return found.select("key_hash", part).distinct()
