"""Running values over an ordered group without putting the group in one task.

A plain window function sends a whole group to one task, so a group that holds
a third of the rows stalls the job.  Here every group is cut into ordered
chunks.  Each chunk is reduced to one summary row, the summaries (a few per
group) are accumulated in chunk order, and the window runs inside
``(group, chunk)`` only, starting from the accumulated value.

Chunks come either from a column that follows the order, such as the offset of
a file split, or from a range partitioning, which samples the order key and so
balances hot groups by construction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import freeze

CHUNK = "_chunk"


@dataclass(frozen=True)
class Running:
    """One running value.

    ``how`` is ``last`` or ``first`` (ignoring nulls), ``max``, ``min`` or
    ``sum``.  ``before`` leaves the current row out.
    """

    name: str
    how: str
    value: Column
    before: bool = False


def range_chunks(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Range-partition by group and order, and keep the partition number as the chunk.

    The ranges are sampled before the rows are moved, so ``df`` is written first and computed once.
    """
    ranged = freeze(df, f"{label}-rows").repartitionByRange(*group, *order).withColumn(CHUNK, F.spark_partition_id())
    return freeze(ranged, label)


def _summary(run: Running, order: list[str]) -> Column:
    key = F.struct(*order)
    value = run.value
    known = F.when(value.isNotNull(), key)
    if run.how == "last":
        return F.max_by(value, known)
    if run.how == "first":
        return F.min_by(value, known)
    return {"max": F.max, "min": F.min, "sum": F.sum}[run.how](value)


def _accumulate(how: str, value: Column, frame) -> Column:
    if how == "last":
        return F.last(value, ignorenulls=True).over(frame)
    if how == "first":
        return F.first(value, ignorenulls=True).over(frame)
    return {"max": F.max, "min": F.min, "sum": F.sum}[how](value).over(frame)


def _merge(how: str, earlier: Column, here: Column) -> Column:
    if how == "last":
        return F.coalesce(here, earlier)
    if how == "first":
        return F.coalesce(earlier, here)
    if how == "max":
        return F.greatest(earlier, here)
    if how == "min":
        return F.least(earlier, here)
    zero = F.lit(0).cast("bigint")
    return F.coalesce(earlier, zero) + F.coalesce(here, zero)


def ordered_scan(
    df: DataFrame, group: list[str], order: list[str], runs: list[Running]
) -> DataFrame:
    """Add one column per running value.  ``df`` carries the ``_chunk`` column.

    Group columns must not be null, and ``order`` must be total within a group.
    """
    kept = df.columns
    summary = df.groupBy(*group, CHUNK).agg(
        *[_summary(r, order).alias(f"_s_{r.name}") for r in runs]
    )
    earlier = (
        Window.partitionBy(*group)
        .orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summary.select(
        *group,
        CHUNK,
        *[_accumulate(r.how, F.col(f"_s_{r.name}"), earlier).alias(f"_c_{r.name}") for r in runs],
    )
    local = Window.partitionBy(*group, CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(carried, [*group, CHUNK], "left")
    return joined.select(
        *kept,
        *[
            _merge(
                r.how,
                F.col(f"_c_{r.name}"),
                _accumulate(r.how, r.value, before if r.before else upto),
            ).alias(r.name)
            for r in runs
        ],
    )
