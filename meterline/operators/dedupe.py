"""Count each observed event once, however many logs replay it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.accounts import dedupe_model
from ..functions.tokens import TOKEN_COLUMNS

_FILLED = ["model", "root_session_id", "turn_id", "reasoning_effort", "provider", "plan_type"]


def merge_tier(tier: Column, order: Column) -> Column:
    """Aggregate: standard beats fast, fast beats anything else, else the first known."""
    return F.coalesce(
        F.max(F.when(tier == "standard", tier)),
        F.max(F.when(tier == "fast", tier)),
        F.min_by(tier, F.when(tier.isNotNull(), order)),
    )


def dedupe_usage(usage: DataFrame) -> DataFrame:
    """One row per (owner, time, model card, six token counts).

    The canonical row is the first that is not a child or fork, by source key.
    Only aggregates, so a group of many copies is combined before the shuffle.
    """
    copied = F.coalesce(F.col("relation").isin("child", "fork"), F.lit(False))
    order = F.struct(copied.alias("copied"), F.col("source_key"))
    keyed = usage.withColumns(
        {
            "_owner": F.coalesce("root_session_id", "session_id"),
            "_model": dedupe_model(F.col("model")),
            "_order": order,
        }
    )
    key = ["_owner", "observed_at_ms", "_model", *TOKEN_COLUMNS]
    first = F.min_by(F.struct("source_key", "session_id", "relation"), F.col("_order"))
    grouped = keyed.groupBy(*key).agg(
        first.alias("_first"),
        merge_tier(F.col("service_tier"), F.col("_order")).alias("service_tier"),
        *[
            F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
            for c in _FILLED
        ],
    )
    return grouped.select(
        "_first.source_key",
        "observed_at_ms",
        "_first.session_id",
        "root_session_id",
        "turn_id",
        "_first.relation",
        "model",
        "service_tier",
        "reasoning_effort",
        "provider",
        "plan_type",
        *TOKEN_COLUMNS,
    )
