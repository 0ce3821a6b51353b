"""Plan, tier, model and capacity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import PLAN_PROFILE, REVIEW_ALIAS, REVIEW_CARD


def effective_plan(plan: Column, provider: Column) -> Column:
    return F.coalesce(plan, F.when(F.lower(provider) == "pro", F.lit("api")))


def usage_context(plan: Column) -> Column:
    """Context of an effective plan: api, subscription or unknown."""
    return (
        F.when(plan.isNull(), F.lit("unknown"))
        .when(F.lower(plan) == "api", F.lit("api"))
        .otherwise(F.lit("subscription"))
    )


def is_api_plan(plan: Column) -> Column:
    return F.coalesce(F.lower(plan) == "api", F.lit(False))


def is_subscription_plan(plan: Column) -> Column:
    return F.coalesce(~F.lower(plan).isin("api", "unknown"), F.lit(False))


def default_profile(plan: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, profile in PLAN_PROFILE.items():
        result = F.when(F.lower(plan) == name, F.lit(profile)).otherwise(result)
    return result


def dedupe_model(model: Column) -> Column:
    lowered = F.lower(model)
    return F.when(lowered == REVIEW_ALIAS, F.lit(REVIEW_CARD)).otherwise(lowered)


def normalize_tier(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(lowered.isin("standard", "default"), F.lit("standard")).when(
        lowered.isin("fast", "priority"), F.lit("fast")
    )


def fast_state(tiers: Column) -> Column:
    """State of a set of tiers; a single tier other than fast counts as standard."""
    return (
        F.when(F.size(tiers) == 0, F.lit("unknown"))
        .when(F.size(tiers) > 1, F.lit("mixed"))
        .when(F.array_contains(tiers, "fast"), F.lit("fast"))
        .otherwise(F.lit("standard"))
    )


def money(micros: Column) -> Column:
    return micros.cast("double") / F.lit(1_000_000.0)


def dollars_per_token(micros_per_million: Column) -> Column:
    return micros_per_million.cast("double") / F.lit(1_000_000_000_000.0)


def remaining_percent(used: Column) -> Column:
    return F.when(used.isNotNull(), F.greatest(F.lit(100.0) - used, F.lit(0.0)))


def unobserved_tokens(account_tokens: Column, local_total: Column) -> Column:
    """Signed: negative when more was seen locally than the account reports."""
    return account_tokens - local_total


def coverage_ratio(account_tokens: Column, local_total: Column) -> Column:
    return F.when(account_tokens > 0, local_total.cast("double") / account_tokens.cast("double"))


def local_percent(credit: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, credit / capacity * 100.0)
