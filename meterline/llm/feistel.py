"""Shuffling into shards by a permutation of row numbers.

Rows get the numbers 0 to N-1 in the order of id, size and checksum.  A Feistel
network permutes the numbers below the next even power of two; a number that
falls outside 0 to N-1 walks on through the same permutation until it is inside
(fewer than four steps on average).  Shard and slot are then arithmetic: place
modulo and divided by the number of shards.  Anyone with the seed, N and a row
number computes its place, and a place leads back to its row number.

The law is ``rows``: counts of shards differ by one at most.

Null ids come first in the order; rows that agree in id, size and checksum are
interchangeable.  An empty table gives an empty result.  Extra columns are
dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, freeze, mix64

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed % 2**32) * np.uint64(1 << 20))


def _network(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ (mix64(right ^ key) & mask)
    return (left << bits) | right


def _back(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for key in keys[::-1]:
        left, right = right ^ (mix64(left ^ key) & mask), left
    return (left << bits) | right


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..n-1, cycle-walked."""
    step, half, keys = (_back if inverse else _network), _half_bits(n), _keys(seed)
    out = step(numbers.astype(np.uint64), half, keys)
    while len(far := np.flatnonzero(out >= n)):
        out[far] = step(out[far], half, keys)
    return out.astype(np.int64)


def place_of(number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("bigint")
    def place(number):
        import pandas as pd

        return pd.Series(permute(number.to_numpy(), n, seed))

    return place(number)


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with numbers 0..N-1 in the order of ``order``, and N.

    Rows are dealt by ranges of the order and sorted there; a table of counts,
    one per range, gives each range its first number.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = freeze(dealt.withColumn("_id", F.monotonically_increasing_id()), "row-numbers")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("part")).count().orderBy("part").collect()
    firsts, total = {}, 0
    for row in counts:
        firsts[row["part"]] = total
        total += row["count"]
    if not counts:
        return dealt.drop("_id").withColumn(name, F.lit(0).cast("bigint")), 0
    starts = df.sparkSession.createDataFrame(list(firsts.items()), "part bigint, first bigint")
    numbered = dealt.withColumn("part", part).join(F.broadcast(starts), "part")  # one row per partition
    return numbered.withColumn(name, F.col("first") + at).drop("part", "first", "_id"), total


def shard(df: DataFrame, order: list[str], shards: int, seed: int) -> DataFrame:
    """``df`` with row_number, shard and slot."""
    numbered, n = row_numbers(df, order)
    place = place_of(F.col("row_number"), n, seed)
    return numbered.withColumn("_place", place).select(
        *numbered.columns, (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place DIV {shards}").alias("slot")
    )


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard(rows, ["doc_id", "size", "text_crc32"], 24, 20240101).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
