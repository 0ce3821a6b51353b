"""Choose the capacity that applies to an account, a plan and a time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.accounts import default_profile, is_subscription_plan
from ..functions.storage import freeze

_CHOICE = "struct<profile_code:string,weekly_credit:double>"


def capacity_rows(canonical: DataFrame) -> list[Row]:
    """The canonical capacities, one per profile code, in their order.

    Tables with capacities of accounts or dates grow; they go to ``with_capacity``.
    """
    return sorted(canonical.collect(), key=lambda r: r.profile_code)


def _best(candidates: list[tuple[Column, list[Column]]], rows: list[Row]) -> Column:
    """The candidate with the greatest rank; the later row wins a tie."""
    ranked = []
    for place, (row, (allowed, rank)) in enumerate(zip(rows, candidates)):
        ranked.append(
            F.when(
                allowed,
                F.struct(
                    *[r.alias(f"r{i}") for i, r in enumerate(rank)],
                    F.lit(place).alias("place"),
                    F.lit(row.profile_code).alias("profile_code"),
                    F.lit(float(row.weekly_credit)).alias("weekly_credit"),
                ),
            )
        )
    if not ranked:
        return F.lit(None).cast(_CHOICE)
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    chosen = F.struct(
        best.getField("profile_code").alias("profile_code"),
        best.getField("weekly_credit").alias("weekly_credit"),
    )
    return F.when(best.isNotNull(), chosen)


def _valid(row: Row, at: Column) -> Column:
    valid = at >= row.effective_from_ms
    return valid if row.effective_to_ms is None else valid & (at < row.effective_to_ms)


def _account_fits(row: Row, account: Column) -> Column:
    if row.account_key is None:
        return F.lit(True)
    return F.coalesce(account == row.account_key, F.lit(False))


def capacity_for(rows: list[Row], account: Column, plan: Column, at: Column) -> Column:
    """Capacity of a subscription plan: exact plan, then profile, then latest start.

    A plan without a profile of its own ties everywhere and takes the last row.
    """
    wanted = default_profile(plan)
    candidates = []
    for row in rows:
        fits = F.lit(True) if row.plan_type is None else F.coalesce(plan == row.plan_type, F.lit(False))
        exact = F.lit(0 if row.plan_type is None else 2)
        profile = F.coalesce(
            (F.lit(row.profile_code.lower()) == wanted).cast("int"), F.lit(0)
        )
        candidates.append(
            (
                _valid(row, at) & _account_fits(row, account) & fits,
                [exact + profile, F.lit(int(row.effective_from_ms)).cast("bigint")],
            )
        )
    return F.when(is_subscription_plan(plan), _best(candidates, rows))


def capacity_for_plan(
    rows: list[Row], account: Column, plan: Column, profile: Column, at: Column
) -> Column:
    """Capacity of a known profile at a time, else the one for the plan."""
    candidates = [
        (
            F.coalesce(profile == row.profile_code, F.lit(False))
            & _valid(row, at)
            & _account_fits(row, account),
            [F.lit(int(row.effective_from_ms)).cast("bigint")],
        )
        for row in rows
    ]
    return F.coalesce(_best(candidates, rows), capacity_for(rows, account, plan, at))


def _candidates(asked: DataFrame, capacities: DataFrame, rule: str) -> DataFrame:
    """Each asked key with the capacities that suit its account and plan, at any time.

    A capacity for all accounts or all plans is met through a null key, so every
    join here is on equal keys.
    """
    shape = lambda c: F.lower(c) if rule == "current" else c
    c = capacities.select(
        F.col("account_key").alias("c_account"),
        shape(F.col("plan_type")).alias("c_plan"),
        F.col("profile_code").alias("c_profile"),
        F.col("weekly_credit").cast("double").alias("c_credit"),
        F.col("effective_from_ms").cast("bigint").alias("c_from"),
        F.col("effective_to_ms").cast("bigint").alias("c_to"),
    )
    nothing = F.lit(None).cast("string")
    by_account = asked.withColumn(
        "m_account", F.explode(F.array_distinct(F.array(nothing, F.col("k_account"))))
    )
    by_plan = by_account.withColumn(
        "m_plan", F.explode(F.array_distinct(F.array(nothing, shape(F.col("k_plan")))))
    )
    suits = F.col("m_account").eqNullSafe(F.col("c_account")) & F.col("m_plan").eqNullSafe(F.col("c_plan"))
    met = by_plan.join(c, suits)
    own_profile = F.coalesce((F.lower("c_profile") == default_profile(F.col("k_plan"))).cast("int"), F.lit(0))
    for_plan = F.when(F.col("c_plan").isNotNull(), 2).otherwise(0)
    if rule == "current":
        return met.filter(own_profile == 1).withColumn(
            "score", for_plan + F.when(F.col("c_account").isNotNull(), 4).otherwise(0)
        )
    found = met.filter(is_subscription_plan(F.col("k_plan"))).withColumn("score", for_plan + own_profile)
    same = F.col("m_account").eqNullSafe(F.col("c_account")) & (F.col("k_profile") == F.col("c_profile"))
    named = by_account.filter("k_profile IS NOT NULL").join(c, same).withColumn("score", F.lit(4))
    columns = ["k_account", "k_plan", "k_profile", "c_account", "c_profile", "c_credit", "c_from", "c_to", "score"]
    return found.select(*columns).unionByName(named.select(*columns))


def with_capacity(
    facts: DataFrame,
    capacities: DataFrame,
    account: Column,
    plan: Column,
    at: Column,
    profile: Column | None = None,
    rule: str = "plan",
) -> DataFrame:
    """``facts`` with ``capacity`` (profile_code, weekly_credit), null where none applies.

    Rule ``plan``: a known ``profile`` that is valid at the time comes first; then,
    for subscription plans, the exact plan, the plan's profile and the latest start.
    Rule ``current``: the profile must be the plan's; a capacity of the account
    comes first, then one of the plan, then the latest start.  Further ties go to
    the greater profile code, then to the account's own.

    The distinct accounts and plans of ``facts`` are laid out in spans of time with one
    choice each; a fact meets its span by account and plan, with the time as residue.
    """
    keys = ["k_account", "k_plan", "k_profile"]
    none = F.lit(None).cast("string")
    keyed = facts.withColumns(
        {
            "k_account": account,
            "k_plan": plan,
            "k_profile": none if profile is None else profile,
            "k_at": at.cast("bigint"),
        }
    )
    found = freeze(_candidates(keyed.select(*keys).distinct(), capacities, rule), "capacity-candidates")
    edges = (
        found.select(*keys, F.explode(F.array("c_from", "c_to")).alias("from_ms"))
        .filter("from_ms IS NOT NULL")
        .distinct()
    )
    spans = edges.withColumn(
        "to_ms", F.lead("from_ms").over(Window.partitionBy(*keys).orderBy("from_ms"))
    )
    f, c = spans.alias("f"), found.alias("c")
    one_key = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    valid = (F.col("c_from") <= F.col("from_ms")) & (F.col("c_to").isNull() | (F.col("from_ms") < F.col("c_to")))
    rank = F.struct("score", "c_from", "c_profile", F.col("c_account").isNotNull(), "c_credit")
    choice = F.struct(F.col("c_profile").alias("profile_code"), F.col("c_credit").alias("weekly_credit"))
    chosen = (
        f.join(c, reduce(and_, [*one_key, valid]))
        .groupBy(*[F.col(f"f.{k}").alias(f"s_{k}") for k in keys], "from_ms", "to_ms")
        .agg(F.max_by(choice, rank).alias("capacity"))
    )
    meets = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    inside = (F.col("from_ms") <= F.col("k_at")) & (F.col("to_ms").isNull() | (F.col("k_at") < F.col("to_ms")))
    return keyed.join(chosen, reduce(and_, [*meets, inside]), "left").select(*facts.columns, "capacity")
