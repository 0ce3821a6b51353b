"""Token-count expressions over the six flat columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_COLUMNS = [
    "input_tokens",
    "cache_read_tokens",
    "cache_write_tokens",
    "output_tokens",
    "reasoning_tokens",
    "total_tokens",
]


def normalized(cols: dict[str, Column]) -> dict[str, Column]:
    """Clamp the six counts; a missing total is input + output."""
    def at_least_zero(c: Column) -> Column:
        return F.greatest(F.coalesce(c, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))

    inp = at_least_zero(cols["input_tokens"])
    out = at_least_zero(cols["output_tokens"])
    total = F.coalesce(cols["total_tokens"], F.lit(0).cast("bigint"))
    return {
        "input_tokens": inp,
        "cache_read_tokens": F.least(at_least_zero(cols["cache_read_tokens"]), inp),
        "cache_write_tokens": at_least_zero(cols["cache_write_tokens"]),
        "output_tokens": out,
        "reasoning_tokens": F.least(at_least_zero(cols["reasoning_tokens"]), out),
        "total_tokens": F.when(total <= 0, inp + out).otherwise(total),
    }


def normalize_tokens(df: DataFrame) -> DataFrame:
    return df.withColumns(normalized({name: F.col(name) for name in TOKEN_COLUMNS}))


def observed(cols: dict[str, Column]) -> Column:
    return reduce(or_, [cols[name] != 0 for name in TOKEN_COLUMNS])


def token_diff(current: Column, previous: Column) -> Column:
    """Struct difference per field, never below zero."""
    return F.struct(
        *[
            F.greatest(
                current.getField(n) - previous.getField(n), F.lit(0).cast("bigint")
            ).alias(n)
            for n in TOKEN_COLUMNS
        ]
    )


def counter_reset(current: Column, previous: Column) -> Column:
    return reduce(or_, [current.getField(n) < previous.getField(n) for n in TOKEN_COLUMNS])


def token_struct(cols: dict[str, Column]) -> Column:
    return F.struct(*[cols[n].alias(n) for n in TOKEN_COLUMNS])


def struct_fields(value: Column) -> dict[str, Column]:
    return {n: value.getField(n) for n in TOKEN_COLUMNS}
