"""Bloom filters in DataFrame functions: built by an aggregation, probed inside a plan without a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Filters larger than this are not put into a plan.
MAX_FILTER_BYTES = 8 << 20
CHUNK = 4096


@dataclass(frozen=True)
class Bloom:
    """`words`: an array of 64-bit words as a scalar subquery."""

    words: Column
    bits: int
    hashes: int
    level: int


def _positions(key: Column, bits: int, hashes: int, level: int) -> list[Column]:
    low = F.lit((1 << 31) - 1)
    a = F.xxhash64(key, F.lit(2 * level)).bitwiseAND(low)
    b = F.xxhash64(key, F.lit(2 * level + 1)).bitwiseAND(low)
    return [F.pmod(a + b * F.lit(j), F.lit(bits)).cast("long") for j in range(hashes)]


def build_bloom(keys: DataFrame, n: int, rate: float, level: int = 1, max_bytes: int = MAX_FILTER_BYTES) -> Bloom | None:
    """A filter over the n keys (column `key`) with that false positive rate; None if it would be too large.

    Its words are a scalar subquery over a written table of one row, so that plans stay small. They are put together in chunks,
    so that the task that makes the row holds arrays and not one object for each word.
    """
    size = max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    if size * 8 > max_bytes:
        return None
    hashes = max(1, round(-math.log2(rate)))
    set_bits = (
        keys.select(F.explode(F.array(*_positions(F.col("key"), size * 64, hashes, level))).alias("p"))
        .groupBy((F.col("p") / 64).cast("long").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    )
    every = keys.sparkSession.range(size).join(set_bits, F.col("id") == F.col("w"), "left")
    words = F.sort_array(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0).cast("long")).alias("v"))))
    chunks = every.groupBy((F.col("id") / CHUNK).cast("long").alias("c")).agg(words.alias("s")).select("c", F.col("s.v").alias("v"))
    row = chunks.agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("s")).select(F.flatten("s.v").alias("words"))
    return Bloom(materialize(row, "bloom").scalar(), size * 64, hashes, level)


def holds(bloom: Bloom, key: Column) -> Column:
    """Whether the key may be among the filter's; a null key is a key like any other."""
    found = F.lit(True)
    for p in _positions(key, bloom.bits, bloom.hashes, bloom.level):
        word = F.get(bloom.words, (p / 64).cast("int"))
        found = found & (F.call_function("shiftrightunsigned", word, (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return found
