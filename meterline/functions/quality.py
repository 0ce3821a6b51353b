"""Quality flags as a bit mask, so that a set union is a hash-friendly ``bit_or``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import QUALITY_FLAGS

BITS = {flag: 1 << position for position, flag in enumerate(QUALITY_FLAGS)}


def flag(name: str, when: Column | None = None) -> Column:
    bit = F.lit(BITS[name])
    return bit if when is None else F.when(when, bit).otherwise(F.lit(0))


def union(*masks: Column) -> Column:
    return reduce(
        lambda left, right: left.bitwiseOR(right), [F.coalesce(m, F.lit(0)) for m in masks]
    )


def has(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(BITS[name])) != 0


def text(mask: str) -> Column:
    """Sorted comma list of the flags set in a mask column; null when none is."""
    parts = ", ".join(f"if({mask} & {BITS[n]} <> 0, '{n}', null)" for n in QUALITY_FLAGS)
    return F.expr(f"nullif(concat_ws(',', {parts}), '')")


def array_text(flags: Column) -> Column:
    """The same text from an array of flags."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(flags)), ","), F.lit(""))


def append(current: Column, name: str) -> Column:
    """Add a flag at the end of a comma list."""
    return F.when(
        current.isNotNull() & (current != ""), F.concat(current, F.lit("," + name))
    ).otherwise(F.lit(name))
