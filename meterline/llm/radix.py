"""Distributed LSD radix sort: ranks of all rows by an integer key, in stable counting-sort passes.

A row is (position, key digits, payload).  One pass takes one digit, from the
least significant up.  Rows are counted by block of positions and digit; the
exclusive prefix sums of these counts, digit by digit and within a digit block
by block, are the destinations of each block's first row of a digit.  A row's
destination is that offset plus its rank among the rows of its block and digit.
After the last pass the position is the final rank.

No task holds more than one block and digit: a block has at most 2 ** BLOCK_BITS
rows, whatever share of the rows one key has.  Each pass writes its table, which
cuts the lineage, so a lost executor costs one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freeze

#: Bits of a digit: a pass has up to 2 ** DIGIT_BITS counters per block.
DIGIT_BITS = 11
#: Bits of a position inside a block.
BLOCK_BITS = 16


def digits_of(widths: list[int], bits: int = DIGIT_BITS) -> list[tuple[int, int, int]]:
    """(part, shift, bits) of each pass, for key parts of these bit widths, least significant part first."""
    return [(k, low, min(bits, width - low)) for k, width in enumerate(widths) for low in range(0, width, bits)]


def _digit(part: str, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(part), shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def counting_pass(rows: DataFrame, digit: Column, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with ``position`` replaced by its destination under ``digit``; equal digits keep their order."""
    names = rows.columns
    dealt = rows.withColumns({"_block": F.shiftright("position", block_bits), "_digit": digit})
    counts = dealt.groupBy("_block", "_digit").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))
    # At most 2 ** DIGIT_BITS rows, whatever the input.
    smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_digit", F.coalesce(F.sum("_all").over(smaller), F.lit(0)).alias("_start"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_block", "_digit", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    offsets = before.join(starts, "_digit").select("_block", "_digit", (F.col("_start") + F.col("_before")).alias("_offset"))
    within = Window.partitionBy("_block", "_digit").orderBy("position")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(offsets, ["_block", "_digit"]).select(
        *[(F.col("_offset") + F.col("_rank")).alias("position") if n == "position" else n for n in names]
    )


def radix_ranks(rows: DataFrame, parts: list[str], widths: list[int], digit_bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Rows with ``position`` set to their rank from 0, by ``parts`` (unsigned longs, least significant first).

    ``rows`` has a unique long ``position`` whose order decides ties; it need not be dense.  ``widths`` are
    the bits in use of each part.  Without any bit in use one pass over an empty digit makes positions dense.
    """
    passes = digits_of(widths, digit_bits) or [(0, 0, 1)]
    for number, (part, shift, bits) in enumerate(passes):
        rows = freeze(counting_pass(rows, _digit(parts[part], shift, bits), block_bits), f"radix-{number}")
    return rows
