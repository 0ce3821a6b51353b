"""Rebuild the four usage tables from the fact tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.accounts import (
    coverage_ratio,
    effective_plan,
    fast_state,
    is_api_plan,
    is_subscription_plan,
    local_percent,
    money,
    unobserved_tokens,
    usage_context,
)
from ..functions.ordered import Running, ordered_scan, range_chunks
from ..functions.storage import freeze, scratch
from ..functions.timeline import day_end_ms, day_start_ms, local_date, minute_start
from ..functions.tokens import TOKEN_COLUMNS, normalize_tokens, observed
from ..operators.capacity import capacity_for, capacity_for_plan, capacity_rows
from ..operators.dedupe import dedupe_usage
from ..operators.pricing import price_events, rate_card
from ..operators.turns import assign_turn
from ..operators.windows import (
    canonical_limit,
    disjoint_windows,
    official_delta,
    official_points,
    quota_window,
    reset_windows,
    usage_window,
)
from ..sources.catalogs import current_capacities
from ..sources.sinks import replace_rollups

NO_WINDOW = "none"


@dataclass(frozen=True)
class Account:
    """The latest account seen by the feed."""

    account_key: str | None = None
    auth_kind: str | None = None
    provider: str | None = None
    plan_type: str | None = None

    def column(self, name: str) -> Column:
        return F.lit(getattr(self, name)).cast("string")


@dataclass(frozen=True)
class Inputs:
    """What a rebuild reads: facts, quota, account, capacities and catalogs."""

    usage: DataFrame
    turns: DataFrame
    sessions: DataFrame
    quota: DataFrame
    account: Account
    account_days: DataFrame
    capacities: DataFrame
    credit: DataFrame
    usd: DataFrame
    default_tier: str = "standard"

    @cached_property
    def capacity_rows(self) -> list[Row]:
        """The canonical capacities: one per profile code, so an expression holds them."""
        return capacity_rows(current_capacities(self.capacities))


# --- facts -----------------------------------------------------------------


def usage_records(usage: DataFrame) -> DataFrame:
    """Normalized usage facts that carry any tokens at all."""
    normal = normalize_tokens(usage)
    return normal.filter(observed({n: F.col(n) for n in TOKEN_COLUMNS}))


def build_windows(quota: DataFrame) -> DataFrame:
    """Disjoint reset windows of canonical quota rows, frozen: small and used often."""
    return freeze(disjoint_windows(reset_windows(quota)), "windows")


def usage_facts(inputs: Inputs, windows: DataFrame) -> DataFrame:
    """Each counted event once, with its window, price, turn and plan context."""
    records = usage_records(inputs.usage)
    counted = freeze(usage_window(dedupe_usage(records), windows, records), "usage-counted", wide=True)
    card = rate_card(counted, inputs.credit, inputs.usd)
    placed = assign_turn(counted, inputs.turns)
    priced = price_events(placed, inputs.credit, inputs.usd, inputs.default_tier, card, counted)
    return freeze(_with_context(priced, inputs), "usage-facts", wide=True)


def _with_context(usage: DataFrame, inputs: Inputs) -> DataFrame:
    plan = effective_plan(F.col("plan_type"), F.col("provider"))
    with_plan = usage.withColumns(
        {
            "plan_type": plan,
            "context": usage_context(plan),
            "minute_start_ms": minute_start(F.col("observed_at_ms")),
            "local_date": local_date(F.col("observed_at_ms")),
        }
    )
    rows = inputs.capacity_rows
    subscription = F.col("context") == "subscription"
    unknown = F.col("context") == "unknown"
    partial = (
        (subscription & F.col("credit_micros").isNull())
        | F.col("api_usd_micros").isNull()
        | unknown
    )
    choice = capacity_for(
        rows, inputs.account.column("account_key"), F.col("plan_type"), F.col("observed_at_ms")
    )
    return with_plan.withColumns(
        {
            "credit_micros": F.when(subscription, F.col("credit_micros")),
            "flags": quality.union(
                F.col("price_flags"),
                quality.flag("pricing_partial", partial),
                quality.flag("account_context_unavailable", unknown),
            ),
            "capacity_profile": choice.getField("profile_code"),
        }
    ).drop("price_flags", "credit_version", "usd_version")


# --- metrics ---------------------------------------------------------------

METRIC_COLUMNS = [*TOKEN_COLUMNS, "credit_micros", "api_usd_micros", "flags"]


def metric() -> list[Column]:
    """Sums of tokens and known money, and the union of flags.

    A money sum over no known amount stays null.
    """
    return [
        *[F.sum(c).alias(c) for c in TOKEN_COLUMNS],
        F.sum("credit_micros").alias("credit_micros"),
        F.sum("api_usd_micros").alias("api_usd_micros"),
        F.bit_or("flags").alias("flags"),
    ]


def usage_cube(facts: DataFrame) -> DataFrame:
    """Facts reduced to (minute, window, plan, profile): the one pass three tables share.

    Its size is bounded by minutes, windows and plans, so the day, minute and
    window tables are built from it without another pass over the events.
    """
    order = F.struct("observed_at_ms", "source_key")
    with_provider = F.when(F.col("provider").isNotNull(), order)
    return freeze(
        facts.groupBy(
            "minute_start_ms", "local_date", "window_id", "plan_type", "capacity_profile"
        ).agg(
            *metric(),
            F.max(order).alias("last_order"),
            F.min(with_provider).alias("provider_order"),
            F.min_by("provider", with_provider).alias("provider"),
        ),
        "usage-cube",
    )


def plan_split(cube: DataFrame, grain: list[str]) -> DataFrame:
    """Metrics per plan and profile inside a grain."""
    unknown = F.lit("unknown")
    key = F.concat_ws(
        ":", F.coalesce("plan_type", unknown), F.coalesce("capacity_profile", unknown)
    )
    return cube.groupBy(*grain, key.alias("plan_key")).agg(
        F.max("plan_type").alias("plan_type"),
        F.max("capacity_profile").alias("capacity_profile"),
        *metric(),
    )


def dominant_plan(split: DataFrame, grain: list[str]) -> DataFrame:
    """Totals of a grain with its display plan and its only subscription, if one.

    Dominance is by credit, else by tokens; the greater key wins a tie.
    """
    subscription = is_subscription_plan(F.col("plan_type"))
    value = F.coalesce(money(F.col("credit_micros")), F.col("total_tokens").cast("double"))
    order = F.struct(value.alias("value"), F.col("plan_key"))
    choice = F.struct("plan_type", "capacity_profile", "credit_micros")
    return (
        split.groupBy(*grain)
        .agg(
            *metric(),
            F.count(F.lit(1)).alias("plan_count"),
            F.count_if(subscription).alias("subscription_count"),
            F.max(is_api_plan(F.col("plan_type"))).alias("has_api"),
            F.max_by(choice, order).alias("_any"),
            F.max_by(choice, F.when(subscription, order)).alias("_subscription"),
        )
        .withColumns(
            {
                "plan_type": F.coalesce(F.col("_subscription.plan_type"), F.col("_any.plan_type")),
                "local_plan": F.when(F.col("subscription_count") == 1, F.col("_subscription")),
                "flags": quality.union(
                    F.col("flags"),
                    quality.flag("mixed_plan", F.col("plan_count") > 1),
                    quality.flag(
                        "mixed_account", F.col("has_api") & (F.col("subscription_count") > 0)
                    ),
                ),
            }
        )
        .drop("_any", "_subscription")
    )


def _money_columns() -> list[Column]:
    return [
        money(F.col("credit_micros")).alias("credit"),
        money(F.col("api_usd_micros")).alias("api_usd"),
    ]


def _local_columns(choice: Column) -> tuple[Column, Column]:
    """Capacity profile and local percent of the only subscription plan of a grain."""
    profile = F.coalesce(
        choice.getField("profile_code"), F.col("local_plan.capacity_profile")
    )
    percent = local_percent(
        money(F.col("local_plan.credit_micros")), choice.getField("weekly_credit")
    )
    return profile, percent


# --- minute ----------------------------------------------------------------


def usage_minute(
    cube: DataFrame, points: DataFrame, windows: DataFrame, inputs: Inputs
) -> DataFrame:
    """One row per minute and window that has usage or a quota observation."""
    account = inputs.account
    by_minute = cube.groupBy("minute_start_ms", F.col("window_id").alias("window_id")).agg(
        *metric(),
        F.max_by("plan_type", F.when(F.col("plan_type").isNotNull(), F.col("last_order"))).alias(
            "last_plan"
        ),
        F.min("plan_type").alias("least_plan"),
        F.max("plan_type").alias("greatest_plan"),
        F.min_by("provider", "provider_order").alias("first_provider"),
        F.min("provider_order").alias("provider_order"),
    )
    key = F.coalesce("window_id", F.lit(NO_WINDOW)).alias("window_key")
    left = by_minute.select("*", key).drop("window_id")
    right = points.select("*", key, F.lit(True).alias("has_quota")).drop("window_id")
    attributes = windows.select(
        F.col("window_id").alias("window_key"),
        "window_id",
        F.col("account_key").alias("w_account"),
        F.col("plan_type").alias("w_plan"),
        "window_kind",
        "window_start_ms",
        "resets_at_ms",
        "ordinal",
        "inferred_after_gap",
    )
    both = left.join(right, ["minute_start_ms", "window_key"], "full").join(
        attributes, "window_key", "left"
    )
    in_window = F.col("window_id").isNotNull()
    start_plan = F.coalesce("w_plan", F.when(in_window, F.col("quota_plan_type")))
    mixed = (F.col("least_plan") != F.col("greatest_plan")) | (
        start_plan.isNotNull() & (start_plan != F.col("greatest_plan"))
    )
    marker = (F.col("ordinal") > 0) & (
        (F.col("window_start_ms") == F.col("minute_start_ms"))
        | (
            F.col("has_quota")
            & (minute_start(F.col("window_start_ms")) == F.col("minute_start_ms"))
        )
    )
    shaped = both.withColumns(
        {
            "account_key": F.coalesce(
                "w_account",
                account.column("account_key"),
                F.when(in_window, F.col("quota_account_key")),
            ),
            "plan_type": F.coalesce(F.col("last_plan"), start_plan),
            "provider": F.coalesce(account.column("provider"), F.col("first_provider")),
            "reset_marker": F.coalesce(marker, F.lit(False)),
            "flags": quality.union(
                F.col("flags"),
                quality.flag("mixed_plan", F.coalesce(mixed, F.lit(False))),
                quality.flag("inferred_after_gap", F.col("inferred_after_gap")),
            ),
        }
    )
    choice = capacity_for(
        inputs.capacity_rows,
        F.coalesce(F.col("account_key"), account.column("account_key")),
        F.col("plan_type"),
        F.col("minute_start_ms"),
    )
    return shaped.select(
        F.concat_ws(":", F.col("minute_start_ms").cast("string"), "window_key").alias("bucket_key"),
        "minute_start_ms",
        local_date(F.col("minute_start_ms")).alias("local_date"),
        "account_key",
        account.column("auth_kind").alias("auth_kind"),
        "plan_type",
        "provider",
        choice.getField("profile_code").alias("capacity_profile"),
        "window_id",
        "window_kind",
        "window_start_ms",
        "resets_at_ms",
        "reset_marker",
        *TOKEN_COLUMNS,
        *_money_columns(),
        "official_used_percent",
        "official_source",
        quality.text("flags").alias("quality"),
        F.col("first_provider").alias("_first_provider"),
        F.col("provider_order").alias("_provider_order"),
    )


# --- day -------------------------------------------------------------------


def official_days(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Official percent of primary windows per local date, with the reset count."""
    primary = windows.filter("window_kind = 'primary'").select(
        "window_id", "window_start_ms", "ordinal", "inferred_after_gap"
    )
    seen = (
        points.filter("official_used_percent is not null")
        .join(primary, "window_id")
        .withColumn("local_date", local_date(F.col("minute_start_ms")))
    )
    marked = (F.col("ordinal") > 0) & (
        minute_start(F.col("window_start_ms")) == F.col("minute_start_ms")
    )
    counts = seen.groupBy("local_date").agg(
        F.count_distinct(F.when(marked, F.col("window_id"))).alias("reset_count"),
        F.bit_or(quality.flag("inferred_after_gap", F.col("inferred_after_gap"))).alias(
            "official_flags"
        ),
    )
    return official_delta(seen, ["local_date"], ["local_date", "window_id"]).join(
        counts, "local_date"
    )


def day_account_tokens(days: DataFrame, account_days: DataFrame) -> DataFrame:
    """Account tokens of each local date, and whether they are there at all."""
    tokens = account_days.select(
        F.col("date").alias("local_date"), F.col("tokens").alias("account_tokens")
    )
    settled = F.when(F.col("account_tokens").isNotNull(), F.lit("settled"))
    return days.join(tokens, "local_date", "left").withColumn(
        "account_token_freshness", settled.otherwise(F.lit("unavailable"))
    )


def usage_daily(
    cube: DataFrame, points: DataFrame, windows: DataFrame, inputs: Inputs
) -> DataFrame:
    """One row per local date with usage or an official point of a primary window."""
    account = inputs.account
    totals = dominant_plan(plan_split(cube, ["local_date"]), ["local_date"])
    days = day_account_tokens(
        totals.join(official_days(points, windows), "local_date", "full"), inputs.account_days
    )
    choice = capacity_for_plan(
        inputs.capacity_rows,
        account.column("account_key"),
        F.col("local_plan.plan_type"),
        F.col("local_plan.capacity_profile"),
        day_start_ms(F.col("local_date")),
    )
    profile, percent = _local_columns(choice)
    has_usage = F.col("total_tokens").isNotNull()
    flags = quality.union(
        F.col("flags"),
        F.col("official_flags"),
        quality.flag("missing_pricing", has_usage & F.col("credit_micros").isNull()),
        quality.flag("official_unavailable", F.col("official_percent_start").isNull()),
        quality.flag("account_tokens_unavailable", F.col("account_tokens").isNull()),
    )
    return days.withColumn("flags", flags).select(
        "local_date",
        account.column("account_key").alias("account_key"),
        account.column("auth_kind").alias("auth_kind"),
        "plan_type",
        profile.alias("capacity_profile"),
        *TOKEN_COLUMNS,
        *_money_columns(),
        percent.alias("local_percent"),
        "account_tokens",
        unobserved_tokens(F.col("account_tokens"), F.col("total_tokens")).alias(
            "unobserved_tokens"
        ),
        coverage_ratio(F.col("account_tokens"), F.col("total_tokens")).alias("coverage_ratio"),
        "account_token_freshness",
        "official_percent_start",
        "official_percent_end",
        "official_percent_delta",
        F.coalesce("reset_count", F.lit(0)).cast("bigint").alias("reset_count"),
        quality.text("flags").alias("quality"),
    )


# --- window ----------------------------------------------------------------


def window_account_tokens(windows: DataFrame, account_days: DataFrame) -> DataFrame:
    """Account tokens of the dates from a window's start to its reset, both included.

    Dates and the ends of all windows lie on one line with running sums: a
    window's tokens are the sum up to its reset less the sum before its start.
    """
    days = account_days.filter(F.date_format(F.try_to_date("date"), "yyyy-MM-dd") == F.col("date"))
    start = local_date(F.col("window_start_ms"))
    end = F.coalesce(local_date(F.col("resets_at_ms")), F.lit("9999-12-31"))

    def end_of(day: Column, side: int) -> DataFrame:
        return windows.select(
            F.lit(0).alias("_all"), day.alias("day"), F.lit(side).alias("side"), F.col("window_id").alias("tie"),
            F.lit(None).cast("bigint").alias("tokens"),
        )

    line = days.select(
        F.lit(0).alias("_all"), F.col("date").alias("day"), F.lit(1).alias("side"), F.lit("").alias("tie"), "tokens"
    ).unionByName(end_of(start, 0)).unionByName(end_of(end, 2))
    order = ["day", "side", "tie"]
    scanned = ordered_scan(
        range_chunks(line, ["_all"], order, "account-line"),
        ["_all"],
        order,
        [
            Running("_sum", "sum", F.col("tokens")),
            Running("_days", "sum", F.when(F.col("tokens").isNotNull(), F.lit(1).cast("bigint"))),
        ],
    ).filter("side <> 1")
    sign = F.col("side") - 1
    return (
        scanned.groupBy(F.col("tie").alias("window_id"))
        .agg(F.sum(sign * F.col("_sum")).alias("account_tokens"), F.sum(sign * F.col("_days")).alias("_days"))
        .filter("_days > 0")
        .drop("_days")
    )


def usage_window_table(
    cube: DataFrame, points: DataFrame, windows: DataFrame, inputs: Inputs
) -> DataFrame:
    """One row per reset window, also for windows without usage."""
    account = inputs.account
    totals = dominant_plan(
        plan_split(cube.filter("window_id is not null"), ["window_id"]), ["window_id"]
    )
    official = official_delta(
        points.filter("official_used_percent is not null and window_id is not null"), ["window_id"]
    )
    segments = windows.select(
        "window_id",
        F.col("account_key").alias("w_account"),
        "limit_id",
        "window_kind",
        "window_start_ms",
        "resets_at_ms",
        "window_minutes",
        "inferred_after_gap",
    )
    rows = (
        segments.join(totals, "window_id", "left")
        .join(official, "window_id", "left")
        .join(window_account_tokens(windows, inputs.account_days), "window_id", "left")
        .withColumn("account_key", F.coalesce("w_account", account.column("account_key")))
    )
    choice = capacity_for_plan(
        inputs.capacity_rows,
        F.col("account_key"),
        F.col("local_plan.plan_type"),
        F.col("local_plan.capacity_profile"),
        F.col("window_start_ms"),
    )
    profile, percent = _local_columns(choice)
    flags = quality.union(
        F.col("flags"),
        quality.flag("inferred_after_gap", F.col("inferred_after_gap")),
        quality.flag("account_tokens_unavailable", F.col("account_tokens").isNull()),
    )
    return rows.withColumn("flags", flags).select(
        "window_id",
        "account_key",
        "limit_id",
        "window_kind",
        "window_start_ms",
        "resets_at_ms",
        "window_minutes",
        account.column("auth_kind").alias("auth_kind"),
        "plan_type",
        account.column("provider").alias("provider"),
        profile.alias("capacity_profile"),
        *TOKEN_COLUMNS,
        *_money_columns(),
        percent.alias("local_percent"),
        "account_tokens",
        unobserved_tokens(F.col("account_tokens"), F.col("total_tokens")).alias(
            "unobserved_tokens"
        ),
        coverage_ratio(F.col("account_tokens"), F.col("total_tokens")).alias("coverage_ratio"),
        "official_percent_start",
        "official_percent_end",
        "official_percent_delta",
        quality.text("flags").alias("quality"),
    )


# --- session ---------------------------------------------------------------


def _session_keyed(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Facts with their session row key and the clamped turn bounds."""
    bounds = windows.select("window_id", "window_start_ms", "resets_at_ms")
    session = F.coalesce("session_id", F.lit("unknown-session"))
    root = F.coalesce("root_session_id", session)
    low = F.greatest(day_start_ms(F.col("local_date")), F.col("window_start_ms"))
    high = F.least(day_end_ms(F.col("local_date")), F.col("resets_at_ms"))
    return (
        facts.join(bounds, "window_id", "left")
        .withColumns({"_session": session, "_root": root, "_low": low, "_high": high})
        .withColumns(
            {
                "row_key": F.concat_ws(
                    ":",
                    "_root",
                    F.coalesce("turn_id", F.lit("unknown")),
                    "local_date",
                    F.coalesce("window_id", F.lit(NO_WINDOW)),
                ),
                "_started": F.greatest(
                    F.coalesce("turn_started_ms", "observed_at_ms"), F.col("_low")
                ),
                "_ended": F.when(
                    F.col("turn_ended_ms").isNotNull(), F.least("turn_ended_ms", "_high")
                ),
                "flags": quality.union(
                    F.col("flags"),
                    quality.flag("root_unresolved", F.col("root_session_id").isNull()),
                    quality.flag("missing_model", F.col("model").isNull()),
                    quality.flag(
                        "split_boundary",
                        (F.col("turn_started_ms") < F.col("_low"))
                        | (F.col("turn_ended_ms") > F.col("_high")),
                    ),
                ),
            }
        )
    )


def session_models(keyed: DataFrame) -> DataFrame:
    """Session rows split by model, tier and effort: the one pass over the events."""
    unknown = F.lit("unknown")
    order = F.struct("observed_at_ms", "source_key")
    first = F.struct(
        "root_session_id",
        F.col("_session").alias("session_id"),
        "turn_id",
        "relation",
        "window_id",
        "plan_type",
        "provider",
        "minute_start_ms",
    )
    return keyed.groupBy(
        "row_key",
        "local_date",
        "model",
        F.when(F.col("model").isNotNull(), F.coalesce("service_tier", unknown)).alias("tier"),
        F.when(F.col("model").isNotNull(), F.coalesce("reasoning_effort", unknown)).alias("effort"),
    ).agg(
        *metric(),
        F.min(order).alias("first_order"),
        F.min_by(first, order).alias("first"),
        F.min("_started").alias("started_at_ms"),
        F.max("_ended").alias("ended_at_ms"),
        F.min("observed_at_ms").alias("observed_start_ms"),
        F.max("observed_at_ms").alias("observed_end_ms"),
    )


def model_breakdown(models: DataFrame) -> DataFrame:
    """Tokens and money per session row, model, tier and effort, as rows."""
    return models.filter("model is not null").select(
        "row_key",
        "local_date",
        "model",
        "tier",
        F.col("effort").alias("reasoning_effort"),
        F.col("total_tokens").alias("tokens"),
        *_money_columns(),
    )


def session_meta(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add title and relation: the root's title, then the session's own.

    A row's relation wins over its session's; without either, a session that
    is not its own root is a child.  Of several rows for one session the last one
    counts, by time and key where ``sessions`` has them.
    """
    order = [F.col(c) for c in ("observed_at_ms", "source_key") if c in sessions.columns]
    last = F.max_by(F.struct("title", "relation"), F.struct(*order, "title", "relation"))
    sessions = sessions.groupBy("session_id").agg(last.alias("_last")).select("session_id", "_last.*")
    root = F.coalesce("root_session_id", "session_id")
    of_root = sessions.select(
        F.col("session_id").alias("_root"), F.col("title").alias("_root_title")
    )
    own = sessions.select(
        "session_id",
        F.col("title").alias("_own_title"),
        F.col("relation").alias("_own_relation"),
    )
    by_place = F.when(F.col("session_id") != F.col("_root"), F.lit("child")).otherwise(
        F.lit("main")
    )
    return (
        rows.withColumn("_root", root)
        .join(of_root, "_root", "left")
        .join(own, "session_id", "left")
        .withColumns(
            {
                "title": F.coalesce("_root_title", "_own_title"),
                "relation": F.coalesce(F.col("relation"), F.col("_own_relation"), by_place),
            }
        )
        .drop("_root", "_root_title", "_own_title", "_own_relation")
    )


def _session_official(sessions: DataFrame, points: DataFrame) -> DataFrame:
    """First and last official percent in the minutes of each session row's window.

    Points and the ends of session rows lie on one line per date and window.  The
    running number of points says how many precede a row's first minute, so its first point
    is the one numbered next; its last point is the latest up to its last minute.
    """
    group = ["local_date", "window_key"]
    seen = points.filter("official_used_percent is not null").select(
        local_date(F.col("minute_start_ms")).alias("local_date"),
        F.coalesce("window_id", F.lit(NO_WINDOW)).alias("window_key"),
        F.col("minute_start_ms").alias("minute"),
        F.lit(1).alias("side"),
        F.lit("").alias("tie"),
        F.col("official_used_percent").alias("percent"),
    )

    def end_of(at: str, side: int) -> DataFrame:
        return sessions.select(
            *group, minute_start(F.col(at)).alias("minute"), F.lit(side).alias("side"), F.col("row_key").alias("tie"),
            F.lit(None).cast("double").alias("percent"),
        )

    order = ["minute", "side", "tie"]
    line = seen.unionByName(end_of("observed_start_ms", 0)).unionByName(end_of("observed_end_ms", 2))
    scanned = freeze(
        ordered_scan(
            range_chunks(line, group, order, "official-line"),
            group,
            order,
            [
                Running("number", "sum", (F.col("side") == 1).cast("bigint")),
                Running("latest", "last", F.col("percent")),
            ],
        ),
        "official-numbered",
    )
    numbered = scanned.filter("side = 1").select(*group, "number", F.col("percent").alias("official_percent_start"))
    ends = (
        scanned.filter("side <> 1")
        .groupBy(*group, F.col("tie").alias("row_key"))
        .agg(
            (F.max(F.when(F.col("side") == 0, F.col("number"))) + 1).alias("number"),
            F.max(F.when(F.col("side") == 2, F.col("number"))).alias("upto"),
            F.max(F.when(F.col("side") == 2, F.col("latest"))).alias("official_percent_end"),
        )
        .filter("number <= upto")
    )
    found = ends.join(numbered, [*group, "number"]).select("row_key", "official_percent_start", "official_percent_end")
    return sessions.join(found, "row_key", "left")


def usage_session(
    models: DataFrame, minute: DataFrame, points: DataFrame, inputs: Inputs
) -> DataFrame:
    """One row per root session, turn, local date and window."""
    account = inputs.account
    named = F.col("model").isNotNull()
    item = F.struct(
        "model",
        "tier",
        F.col("effort").alias("reasoning_effort"),
        F.col("total_tokens").alias("tokens"),
        *_money_columns(),
    )
    rows = models.groupBy("row_key", "local_date").agg(
        *metric(),
        F.min("first_order").alias("first_order"),
        F.min_by("first", "first_order").alias("first"),
        F.min("started_at_ms").alias("started_at_ms"),
        F.max("ended_at_ms").alias("ended_at_ms"),
        F.min("observed_start_ms").alias("observed_start_ms"),
        F.max("observed_end_ms").alias("observed_end_ms"),
        F.array_sort(F.collect_list(F.when(named, item))).alias("model_breakdown"),
        F.collect_set(F.when(named, F.col("tier"))).alias("tiers"),
    )
    rows = rows.select("*", "first.*").withColumn(
        "window_key", F.coalesce("window_id", F.lit(NO_WINDOW))
    )
    rows = session_meta(rows, inputs.sessions).join(
        minute.select(
            "minute_start_ms",
            F.coalesce("window_id", F.lit(NO_WINDOW)).alias("window_key"),
            "account_key",
            "_first_provider",
            "_provider_order",
        ),
        ["minute_start_ms", "window_key"],
        "left",
    )
    # The official percent reads the rows three times.
    rows = _session_official(freeze(rows, "session-rows", wide=True), points)
    seen_provider = F.when(F.col("_provider_order") <= F.col("first_order"), F.col("_first_provider"))
    flags = quality.union(
        F.col("flags"),
        quality.flag("official_unavailable", F.col("official_percent_start").isNull()),
    )
    choice = capacity_for(
        inputs.capacity_rows,
        F.coalesce(F.col("account_key"), account.column("account_key")),
        F.col("plan_type"),
        F.coalesce("started_at_ms", F.lit(0)),
    )
    breakdown = F.when(
        F.size("model_breakdown") > 0,
        F.to_json("model_breakdown", {"ignoreNullFields": "false"}),
    )
    return rows.withColumn("flags", flags).select(
        "row_key",
        "local_date",
        "root_session_id",
        "session_id",
        "turn_id",
        "title",
        "relation",
        "started_at_ms",
        "ended_at_ms",
        "window_id",
        F.coalesce(F.col("account_key"), account.column("account_key")).alias("account_key"),
        account.column("auth_kind").alias("auth_kind"),
        "plan_type",
        F.coalesce(account.column("provider"), seen_provider).alias("provider"),
        choice.getField("profile_code").alias("capacity_profile"),
        F.when(F.size("model_breakdown") == 1, F.col("model_breakdown")[0]["model"]).alias(
            "primary_model"
        ),
        fast_state(F.col("tiers")).alias("fast_state"),
        breakdown.alias("model_breakdown_json"),
        *TOKEN_COLUMNS,
        *_money_columns(),
        "official_percent_start",
        "official_percent_end",
        quality.text("flags").alias("quality"),
    )


class Rollups:
    """The four usage tables.  What they share is computed once, when first needed."""

    def __init__(self, inputs: Inputs):
        self.inputs = inputs

    @cached_property
    def quota(self) -> DataFrame:
        return freeze(canonical_limit(self.inputs.quota), "canonical-quota")

    @cached_property
    def windows(self) -> DataFrame:
        return build_windows(self.quota)

    @cached_property
    def points(self) -> DataFrame:
        return freeze(official_points(quota_window(self.quota, self.windows)), "official-points")

    @cached_property
    def facts(self) -> DataFrame:
        return usage_facts(self.inputs, self.windows)

    @cached_property
    def cube(self) -> DataFrame:
        return usage_cube(self.facts)

    @cached_property
    def _minute(self) -> DataFrame:
        return usage_minute(self.cube, self.points, self.windows, self.inputs)

    @cached_property
    def minute(self) -> DataFrame:
        return self._minute.drop("_first_provider", "_provider_order")

    @cached_property
    def daily(self) -> DataFrame:
        return usage_daily(self.cube, self.points, self.windows, self.inputs)

    @cached_property
    def window(self) -> DataFrame:
        return usage_window_table(self.cube, self.points, self.windows, self.inputs)

    @cached_property
    def models(self) -> DataFrame:
        return session_models(_session_keyed(self.facts, self.windows))

    @cached_property
    def session(self) -> DataFrame:
        return usage_session(self.models, self._minute, self.points, self.inputs)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "usage_daily": self.daily,
            "usage_minute": self.minute,
            "usage_window": self.window,
            "usage_session": self.session,
        }


def publish_rollups(inputs: Inputs, root: str, keep: int = 2) -> str:
    """Rebuild the four tables, publish them as one version and leave no scratch."""
    spark = inputs.usage.sparkSession
    with scratch(spark):
        return replace_rollups(Rollups(inputs).tables(), root, keep)
