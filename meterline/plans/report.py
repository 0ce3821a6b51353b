"""Report sections over the eight tables, each a DataFrame of its own."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import CANDIDATE_MIN_PERCENT, CANONICAL_LIMIT, CAPACITY_DEFAULTS, FRESH_MAX_AGE_MS
from ..functions.accounts import default_profile, money, remaining_percent
from ..functions.ordered import Running, ordered_scan, range_chunks
from ..functions.slopes import slope_spread, steepest
from ..functions.storage import freeze
from ..functions.tokens import TOKEN_COLUMNS
from ..operators.pricing import price_card, pricing_version
from ..sources.account_feed import latest_account
from ..sources.catalogs import current_capacities

_BREAKDOWN = (
    "array<struct<model string, tier string, reasoning_effort string, tokens bigint, "
    "credit double, api_usd double>>"
)


def _micros(amount: str) -> Column:
    """Amounts are sums of whole micros, so they add exactly as integers."""
    return F.round(F.col(amount) * 1_000_000).cast("bigint")


def strict_metric() -> list[Column]:
    """Token sums, and money only when every contributing row knows it."""
    cells = [*TOKEN_COLUMNS, "credit", "api_usd"]
    used = F.coalesce(*[F.col(c).cast("double") for c in cells]).isNotNull()

    def amount(name: str) -> Column:
        complete = F.count(F.when(used & F.col(name).isNull(), F.lit(1))) == 0
        return F.when(complete, money(F.sum(_micros(name)))).alias(name)

    counted = F.count(F.when(used, F.lit(1))) > 0
    return [
        *[
            F.when(counted, F.coalesce(F.sum(F.when(used, F.col(c))), F.lit(0))).alias(c)
            for c in TOKEN_COLUMNS
        ],
        amount("credit"),
        amount("api_usd"),
    ]


# --- selection and views ---------------------------------------------------


def selected_date(daily: DataFrame, wanted: str | None = None) -> DataFrame:
    """The wanted date if it has a row, else the last date."""
    asked = F.lit(wanted).cast("string")
    return daily.agg(
        F.coalesce(F.max(F.when(F.col("local_date") == asked, asked)), F.max("local_date")).alias(
            "date"
        )
    )


_USAGE = {
    "input_tokens": "input",
    "cache_read_tokens": "cached",
    "cache_write_tokens": "cache_write",
    "output_tokens": "output",
    "reasoning_tokens": "reasoning",
    "total_tokens": "total",
}


def _usage_struct() -> Column:
    return F.struct(*[F.col(c).alias(short) for c, short in _USAGE.items()]).alias("usage")


def day_view(daily: DataFrame) -> DataFrame:
    drop = {"local_date", "account_key", "auth_kind", *TOKEN_COLUMNS}
    rest = [c for c in daily.columns if c not in drop]
    return daily.select(F.col("local_date").alias("date"), _usage_struct(), *rest)


def minute_view(minute: DataFrame) -> DataFrame:
    return minute.select(
        "minute_start_ms",
        "local_date",
        "window_id",
        "window_kind",
        "window_start_ms",
        "resets_at_ms",
        "reset_marker",
        _usage_struct(),
        "credit",
        "api_usd",
        "official_used_percent",
        "official_source",
        "quality",
    )


def capacity_view(capacities: DataFrame) -> DataFrame:
    return current_capacities(capacities).select(
        F.col("profile_code").alias("plan_code"),
        F.col("weekly_credit").alias("credit"),
        "weekly_credit",
        "account_key",
        "plan_type",
        "effective_from_ms",
        "effective_to_ms",
        F.lit("confirmed").alias("status"),
    )


# --- models and sessions ---------------------------------------------------


def report_models(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of the model breakdowns; an amount is known when the last item knows it."""
    items = sessions.select(
        *(keys or []),
        "started_at_ms",
        "row_key",
        F.posexplode(F.from_json("model_breakdown_json", _BREAKDOWN)).alias("place", "i"),
    ).select("*", "i.*")
    order = F.struct("started_at_ms", "row_key", "place")

    def amount(name: str) -> Column:
        last_known = F.max_by(F.col(name).isNotNull(), order)
        return F.when(last_known, money(F.sum(_micros(name)))).alias(name)

    unknown = F.lit("unknown")
    return (
        items.filter("model is not null")
        .groupBy(
            *(keys or []),
            "model",
            F.coalesce("tier", unknown).alias("tier"),
            F.coalesce("reasoning_effort", unknown).alias("reasoning_effort"),
        )
        .agg(F.sum("tokens").alias("tokens"), amount("credit"), amount("api_usd"))
    )


def _session_group() -> Column:
    return F.coalesce("root_session_id", "session_id", F.lit("unknown-session"))


def _first_effort() -> Column:
    items = F.from_json("model_breakdown_json", _BREAKDOWN)
    return F.try_element_at(items, F.lit(1)).getField("reasoning_effort")


def report_sessions(sessions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per root session; its turns are the rows of ``report_turns``."""
    order = F.struct("started_at_ms", "row_key")
    first = F.struct(
        "title",
        "relation",
        F.col("primary_model").alias("primary_model"),
        _first_effort().alias("reasoning_effort"),
    )
    return (
        sessions.groupBy(*(keys or []), _session_group().alias("session_root"))
        .agg(
            F.min_by(first, order).alias("f"),
            F.min("started_at_ms").alias("started_at_ms"),
            F.max("ended_at_ms").alias("ended_at_ms"),
            F.array_sort(F.collect_set("primary_model")).alias("models"),
            F.array_sort(F.collect_set("fast_state")).alias("fast"),
            F.count(F.lit(1)).alias("turn_count"),
            *strict_metric(),
        )
        .select(
            *(keys or []),
            F.col("session_root").alias("root_session_id"),
            "f.*",
            "started_at_ms",
            "ended_at_ms",
            "models",
            "fast",
            "turn_count",
            *TOKEN_COLUMNS,
            "credit",
            "api_usd",
        )
    )


def report_turns(sessions: DataFrame) -> DataFrame:
    """Turn rows of the session section, to be read in (started, row key) order."""
    return sessions.select(
        "local_date",
        "window_id",
        _session_group().alias("root_session_id"),
        "row_key",
        "turn_id",
        "session_id",
        "title",
        "started_at_ms",
        "ended_at_ms",
        F.col("primary_model").alias("model"),
        F.col("fast_state").alias("fast"),
        _first_effort().alias("reasoning_effort"),
        _usage_struct(),
        "credit",
        "api_usd",
    )


def window_detail(windows: DataFrame, minute: DataFrame, sessions: DataFrame) -> DataFrame:
    """Windows with the size of their minute and session lists.

    The lists themselves stay tables, keyed by ``window_id``.
    """
    minutes = minute.filter("window_id is not null").groupBy("window_id").agg(
        F.count(F.lit(1)).alias("minute_count")
    )
    counts = sessions.filter("window_id is not null").groupBy("window_id").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.count_distinct(_session_group()).alias("root_count"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        windows.join(minutes, "window_id", "left")
        .join(counts, "window_id", "left")
        .withColumns(
            {n: F.coalesce(n, zero) for n in ("minute_count", "session_count", "root_count")}
        )
    )


# --- reconciliation --------------------------------------------------------


def latest_run(external: DataFrame) -> DataFrame:
    """Rows of the latest run per scope, scheme and speed; all rows of a tie."""
    keys = ["scope", "pricing_scheme", "speed"]
    newest = external.groupBy(*keys).agg(F.max("run_at_ms").alias("run_at_ms"))
    return external.join(newest, [*keys, "run_at_ms"], "left_semi")


def validation(external: DataFrame, daily: DataFrame) -> DataFrame:
    """Latest external totals against the local total of the same date."""
    local = daily.select(
        F.col("local_date").alias("scope_key"), F.col("total_tokens").alias("local")
    )
    other = F.col("total_tokens")
    return latest_run(external).join(local, "scope_key").select(
        F.col("scope_key").alias("date"),
        F.lit("total_tokens").alias("metric"),
        "local",
        other.alias("external"),
        (other - F.col("local")).alias("diff"),
        F.col("pricing_scheme").alias("pricing"),
        "speed",
        F.when(F.coalesce(other == F.col("local"), F.lit(False)), F.lit("match"))
        .otherwise(F.lit("diff"))
        .alias("status"),
    )


def fast_surcharge(external: DataFrame) -> DataFrame:
    """What fast tiers add: the auto amount over the standard amount, never negative."""
    keys = ["scope", "scope_key", "pricing_scheme"]

    def amount(speed: str) -> Column:
        return F.max(F.when(F.col("speed") == speed, F.col("amount")))

    surcharge = F.greatest(F.col("auto_amount") - F.col("standard_amount"), F.lit(0.0))
    both = F.col("auto_amount").isNotNull() & F.col("standard_amount").isNotNull()
    return (
        latest_run(external)
        .groupBy(*keys)
        .agg(amount("auto").alias("auto_amount"), amount("standard").alias("standard_amount"))
        .withColumn("fast_surcharge", F.when(both, surcharge))
    )


def external_field_compare(external: DataFrame, daily: DataFrame) -> DataFrame:
    """Field by field differences; external input leaves cache reads out."""
    local = daily.select(
        F.col("local_date").alias("scope_key"),
        (F.col("input_tokens") - F.col("cache_read_tokens")).alias("local_input_tokens"),
        *[F.col(c).alias(f"local_{c}") for c in TOKEN_COLUMNS if c != "input_tokens"],
        F.col("credit").alias("local_credit"),
        F.col("api_usd").alias("local_api_usd"),
    )
    money_here = F.when(F.col("pricing_scheme") == "subscription", F.col("local_credit")).otherwise(
        F.col("local_api_usd")
    )
    return latest_run(external).filter("scope = 'daily'").join(local, "scope_key").select(
        "scope_key",
        "pricing_scheme",
        "speed",
        *[
            (F.col(c) - F.col(f"local_{c}")).alias(f"{c.removesuffix('_tokens')}_diff")
            for c in TOKEN_COLUMNS
        ],
        F.round(F.col("amount") - money_here, 6).alias("amount_diff"),
    )


# --- capacity and curves ---------------------------------------------------


def minute_cumulative(minute: DataFrame) -> DataFrame:
    """Running totals from local midnight; the window series starts again at a reset.

    A date holds the minutes of every window, so it is summed in chunks; a
    window has at most 1,440 minutes of a date.
    """
    chunks = range_chunks(
        minute.select(
            "bucket_key",
            "local_date",
            "minute_start_ms",
            "window_id",
            F.coalesce("window_id", F.lit("none")).alias("window_key"),
            "total_tokens",
            _micros("credit").alias("credit_micros"),
            _micros("api_usd").alias("api_usd_micros"),
            "official_used_percent",
        ),
        ["local_date"],
        ["minute_start_ms", "window_key"],
        "minute-line",
    )
    names = ["total_tokens", "credit_micros", "api_usd_micros"]
    runs = [Running(f"sum_{n}", "sum", F.col(n)) for n in names]
    # A sum over no known amount yet stays null.
    runs += [Running(f"any_{n}", "first", F.col(n)) for n in names]
    summed = ordered_scan(chunks, ["local_date"], ["minute_start_ms", "window_key"], runs)

    def total(name: str) -> Column:
        return F.when(F.col(f"any_{name}").isNotNull(), F.col(f"sum_{name}"))

    window = Window.partitionBy("local_date", "window_key").orderBy("minute_start_ms").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return summed.select(
        "bucket_key",
        "local_date",
        "minute_start_ms",
        "window_id",
        total("total_tokens").alias("cumulative_tokens"),
        money(total("credit_micros")).alias("cumulative_credit"),
        money(total("api_usd_micros")).alias("cumulative_api_usd"),
        money(F.sum("credit_micros").over(window)).alias("window_credit"),
        "official_used_percent",
        remaining_percent(F.col("official_used_percent")).alias("official_remaining_percent"),
    )


def _curve(minute: DataFrame) -> DataFrame:
    """Official points of each window with the local credit spent up to their minute."""
    spent = Window.partitionBy("window_id").orderBy("minute_start_ms").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        minute.filter("window_id is not null")
        .select(
            "window_id",
            "minute_start_ms",
            F.col("official_used_percent").alias("percent"),
            F.coalesce(F.sum(_micros("credit")).over(spent), F.lit(0)).alias("spent"),
        )
        .filter("percent is not null")
    )


def capacity_candidates(minute: DataFrame, min_delta: float = CANDIDATE_MIN_PERCENT) -> DataFrame:
    """Largest implied weekly capacity of each window over all its intervals, and their number.

    An interval runs between two official points of a window that are at
    least ``min_delta`` percent apart.  The best one is the steepest line between two such
    points, found on the hull of the lower ones; intervals are counted by
    ranks.  A window has at most one point a minute, so a group is bounded by its span.
    """
    schema = "window_id string, candidate double, from_ms bigint, to_ms bigint, from_percent double, to_percent double, intervals bigint"

    def one(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("minute_start_ms")
        ms, spent = points["minute_start_ms"].to_numpy(), points["spent"].to_numpy()
        found = steepest(ms, points["percent"].to_numpy(float), spent, min_delta)
        rows = [] if found is None else [(points["window_id"].iloc[0], *found)]
        return pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])

    return _curve(minute).groupBy("window_id").applyInPandas(one, schema)


def candidate_spread(minute: DataFrame, min_delta: float = CANDIDATE_MIN_PERCENT) -> DataFrame:
    """Median and spread of the candidates between percent checkpoints of a window.

    A checkpoint is the first point at which a percent value is seen.
    """
    points = _curve(minute).groupBy("window_id", "percent").agg(
        F.min("minute_start_ms").alias("minute_start_ms"), F.min("spent").alias("spent")
    )
    schema = "window_id string, checkpoint_intervals bigint, median_candidate double, spread double"

    def one(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("percent")
        ms, spent = points["minute_start_ms"].to_numpy(), points["spent"].to_numpy()
        found = slope_spread(ms, points["percent"].to_numpy(float), spent, min_delta)
        rows = [] if found is None else [(points["window_id"].iloc[0], *found)]
        return pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])

    return points.groupBy("window_id").applyInPandas(one, schema)


def unobserved_percent(windows: DataFrame) -> DataFrame:
    """Official rise that local usage does not explain, never negative."""
    gap = F.col("official_percent_delta") - F.col("local_percent")
    return windows.select(
        "window_id",
        "official_percent_delta",
        "local_percent",
        F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))).alias("unobserved_percent"),
    )


# --- current state ---------------------------------------------------------


def preferred_quota(rows: DataFrame, seen: Column, keys: list[str] | None = None) -> DataFrame:
    """Latest quota row of the best tier: canonical primary, any primary, any."""
    primary = F.coalesce(F.col("window_kind") == "primary", F.lit(True))
    canonical = F.coalesce(F.col("limit_id") == CANONICAL_LIMIT, F.lit(False))
    tier = F.when(primary & canonical, 2).when(primary, 1).otherwise(0)
    value = F.struct(
        "source_key",
        "limit_id",
        "window_kind",
        "used_percent",
        "window_minutes",
        "resets_at_ms",
        "plan_type",
        (F.col("account_key") if "account_key" in rows.columns else F.lit(None).cast("string")).alias("account_key"),
        seen.alias("seen_at_ms"),
    )
    picked = F.max_by(value, F.struct(tier, seen, F.col("source_key"))).alias("q")
    grouped = rows.groupBy(*keys) if keys else rows
    return grouped.agg(picked).select(*(keys or []), "q.*")


def nearest_window(windows: DataFrame, reset_ms: int | None) -> DataFrame:
    """Primary window whose reset is nearest; else the last primary, else the last window."""
    order = F.struct("window_start_ms", "window_id")
    row = F.struct(*windows.columns)
    primary = F.col("window_kind") == "primary"
    last_primary = F.max_by(row, F.when(primary, order))
    choices = [last_primary, F.max_by(row, order)]
    if reset_ms is not None:
        far = F.coalesce(F.abs(F.col("resets_at_ms") - F.lit(reset_ms)), F.lit(2**63 - 1))
        choices.insert(0, F.min_by(row, F.when(primary, F.struct(far, order))))
    return windows.agg(F.coalesce(*choices).alias("w")).filter("w is not null").select("w.*")


def _one_row(df: DataFrame, prefix: str) -> DataFrame:
    """A frame of one row at most, its columns prefixed, with a key that all such frames share."""
    return df.select(F.lit(1).alias("_one"), *[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _fresh(seen: str, now_ms: int) -> Column:
    return F.coalesce((F.col(seen) > 0) & (F.lit(now_ms) - F.col(seen) <= FRESH_MAX_AGE_MS), F.lit(False))


def _shown_capacity(state: DataFrame, capacities: DataFrame, now_ms: int) -> DataFrame:
    """The best current capacity for the state's account and plan, over all capacities."""
    rows = current_capacities(capacities)
    asked = rows.withColumn("_one", F.lit(1)).join(
        state.select("_one", F.col("account_key").alias("_account"), F.col("plan").alias("_plan")), "_one"
    )
    shared, any_plan = F.col("account_key").isNull(), F.col("plan_type").isNull()
    fits = (
        (F.col("effective_from_ms") <= now_ms)
        & (F.col("effective_to_ms").isNull() | (F.lit(now_ms) < F.col("effective_to_ms")))
        & (shared | (F.col("account_key") == F.col("_account")))
        & (any_plan | (F.lower("plan_type") == F.lower("_plan")))
        & (F.lower("profile_code") == default_profile(F.col("_plan")))
    )
    score = F.when(shared, 0).otherwise(4) + F.when(any_plan, 0).otherwise(2)
    rank = F.struct(score, "effective_from_ms", "profile_code")
    return asked.filter(fits).agg(F.max_by("weekly_credit", rank).alias("weekly_credit"))


def _shown_window(state: DataFrame, windows: DataFrame) -> DataFrame:
    """As ``nearest_window``, with the reset taken from the state."""
    near = windows.withColumn("_one", F.lit(1)).join(state.select("_one", F.col("resets_at_ms").alias("_reset")), "_one")
    row, order = F.struct(*windows.columns), F.struct("window_start_ms", "window_id")
    primary = F.col("window_kind") == "primary"
    far = F.coalesce(F.abs(F.col("resets_at_ms") - F.col("_reset")), F.lit(2**63 - 1))
    nearest = F.min_by(row, F.when(primary & F.col("_reset").isNotNull(), F.struct(far, order)))
    best = F.coalesce(nearest, F.max_by(row, F.when(primary, order)), F.max_by(row, order))
    return near.agg(best.alias("w")).filter("w is not null").select("w.*")


def current(
    feed: DataFrame,
    logs: DataFrame,
    minute: DataFrame,
    windows: DataFrame,
    capacities: DataFrame,
    now_ms: int,
) -> DataFrame:
    """Current account, official quota and local window, as one row.

    Each input is reduced to one row, and these rows are joined.
    """
    feed_quota = preferred_quota(feed.filter("kind = 'quota' and status = 'ok'"), F.col("last_seen_at_ms"))
    log_quota = preferred_quota(logs.filter("kind = 'quota'"), F.coalesce("last_seen_at_ms", "observed_at_ms"))
    recent = minute.filter(
        F.col("official_used_percent").isNotNull()
        & (F.col("minute_start_ms") > 0)
        & (F.lit(now_ms) - F.col("minute_start_ms") <= FRESH_MAX_AGE_MS)
    ).agg(
        F.max_by(
            F.struct("official_used_percent", "official_source", "resets_at_ms"),
            F.struct("minute_start_ms", "bucket_key"),
        ).alias("m")
    )
    state = feed.sparkSession.range(1).select(F.lit(1).alias("_one"))
    for frame, prefix in (
        (latest_account(feed, only_ok=True), "a_"), (feed_quota, "f_"), (log_quota, "l_"), (recent.select("m.*"), "m_")
    ):
        state = state.join(_one_row(frame, prefix), "_one", "left")
    feed_fresh, log_fresh = _fresh("f_seen_at_ms", now_ms), _fresh("l_seen_at_ms", now_ms)

    def quota(name: str) -> Column:
        return F.when(feed_fresh, F.col(f"f_{name}")).when(log_fresh, F.col(f"l_{name}"))

    any_recent = F.col("m_official_used_percent").isNotNull()
    source = (
        F.when(feed_fresh, "app_server").when(log_fresh, "jsonl")
        .when(any_recent & F.coalesce(F.col("m_official_source") == "app_server", F.lit(False)), "app_server")
        .when(any_recent, "jsonl").otherwise("none")
    )
    state = freeze(
        state.select(
            "_one",
            F.coalesce("a_account_key", quota("account_key")).alias("account_key"),
            F.coalesce("a_plan_type", "f_plan_type", "l_plan_type").alias("plan"),
            F.col("a_account_label").alias("label"),
            F.col("a_auth_kind").alias("auth_kind"),
            F.col("a_provider").alias("provider"),
            F.col("a_last_seen_at_ms").alias("observed_at_ms"),
            F.coalesce(quota("used_percent"), F.col("m_official_used_percent")).alias("used_percent"),
            F.coalesce(quota("resets_at_ms"), F.col("m_resets_at_ms")).alias("resets_at_ms"),
            quota("window_minutes").alias("window_minutes"),
            source.alias("source"),
            feed_fresh.alias("feed_fresh"),
            log_fresh.alias("log_fresh"),
            F.col("f_source_key").isNotNull().alias("feed_any"),
        ),
        "current-state",
    )
    row = state.join(_one_row(_shown_capacity(state, capacities, now_ms), ""), "_one", "left").join(
        _one_row(_shown_window(state, windows), "w_"), "_one", "left"
    )
    available = F.col("used_percent").isNotNull() | F.col("resets_at_ms").isNotNull()
    flags = [
        F.when(~F.col("feed_fresh"), F.when(F.col("feed_any"), "app_server_stale").otherwise("app_server_unavailable")),
        F.when(F.col("log_fresh") & ~F.col("feed_fresh"), "official_fallback_jsonl"),
        F.when(~available, "official_unavailable"),
        F.when(F.col("weekly_credit").isNull(), "capacity_unconfirmed"),
    ]
    return row.select(
        F.coalesce("label", "plan").alias("display"),
        "account_key",
        "auth_kind",
        "plan",
        "provider",
        "weekly_credit",
        "observed_at_ms",
        "used_percent",
        F.greatest(F.lit(100.0) - F.col("used_percent"), F.when(F.col("used_percent").isNotNull(), 0.0)).alias("remaining_percent"),
        "resets_at_ms",
        "window_minutes",
        F.when(available, F.col("source")).otherwise("none").alias("source"),
        F.when(available, F.col("w_window_id")).alias("window_id"),
        F.col("w_window_id").alias("local_window_id"),
        F.col("w_window_start_ms").alias("local_start_at_ms"),
        F.when(F.col("resets_at_ms").isNotNull(), F.col("w_resets_at_ms")).alias("local_reset_at_ms"),
        F.col("w_total_tokens").alias("local_tokens"),
        F.col("w_credit").alias("local_credit"),
        F.col("w_api_usd").alias("local_api_usd"),
        F.when(F.col("weekly_credit") > 0, F.col("w_credit") / F.col("weekly_credit") * 100.0).alias("local_percent"),
        F.when(~available, True).alias("official_stale"),
        F.filter(F.array(*flags), lambda x: x.isNotNull()).alias("quality_flags"),
    )


# --- counts and the whole report -------------------------------------------


def audit(
    daily: DataFrame, sessions: DataFrame, windows: DataFrame, logs: DataFrame, external: DataFrame
) -> DataFrame:
    """Row counts, each an aggregate of one table, stacked as name and value."""
    def one(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("bigint").alias("value")).select(F.lit(name).alias("name"), "value")

    rows = F.count(F.lit(1))
    return (
        one(daily, "lines", rows)
        .unionByName(one(logs, "events", F.count_if(F.col("kind") == "usage")))
        .unionByName(one(sessions, "sessions", F.count_distinct("root_session_id")))
        .unionByName(one(logs, "source_rows", rows))
        .unionByName(one(windows, "window_rows", rows))
        .unionByName(one(external, "ccusage_rows", rows))
    )


def sync_counts(logs: DataFrame, daily: DataFrame) -> DataFrame:
    """Number of days and the time of the last usage fact."""
    days = daily.agg(F.count(F.lit(1)).alias("value")).select(F.lit("days").alias("name"), "value")
    last = logs.filter("kind = 'usage'").agg(F.max("observed_at_ms").alias("value"))
    return days.unionByName(last.select(F.lit("last_usage_ms").alias("name"), "value"))


def feed_daily_tokens(feed: DataFrame) -> DataFrame:
    """Every item of the latest feed usage row that has a start date and tokens, with when it was seen."""
    order = F.struct("last_seen_at_ms", "source_key")
    latest = feed.filter("kind = 'usage'").agg(
        F.max_by(F.struct("daily_tokens_json", "last_seen_at_ms"), order).alias("u")
    ).select("u.*")
    items = F.from_json("daily_tokens_json", "array<struct<startDate string, tokens bigint>>")
    return latest.select("last_seen_at_ms", F.explode(items).alias("d")).filter(
        "d.startDate is not null and d.tokens is not null"
    ).select(
        F.col("d.startDate").alias("date"),
        F.col("d.tokens").alias("tokens"),
        F.lit("app_server").alias("source"),
        F.col("last_seen_at_ms").alias("observed_at_ms"),
    )


#: Names the rules by which the tables are computed; it changes when a result does.
CALCULATION_VERSION = "rollups-1"
FORMULAS = [
    "total tokens: input that was not cached, cached input and output",
    "credit: credit rates of model and tier that held when the event happened",
    "api_usd: dollar rates of model and tier that held when the event happened",
    "local_percent: credit as a share of the confirmed weekly credit",
]


def methodology(credit: DataFrame, usd: DataFrame) -> DataFrame:
    """Formulas, sources, defaults and the catalog versions in force."""
    defaults = F.lit(",".join(f"{k}={v:g}" for k, v in CAPACITY_DEFAULTS.items()))
    return pricing_version(credit, usd).select(
        F.lit(CALCULATION_VERSION).alias("calculation_version"),
        "pricing_version",
        F.array(*[F.lit(s) for s in ("jsonl", "app_server", "ccusage")]).alias("sources"),
        F.array(*[F.lit(f) for f in FORMULAS]).alias("formulas"),
        defaults.alias("capacity_defaults"),
    )


def report_sections(
    tables: dict[str, DataFrame],
    logs: DataFrame,
    feed: DataFrame,
    external: DataFrame,
    capacities: DataFrame,
    credit: DataFrame,
    usd: DataFrame,
    now_ms: int,
    wanted: str | None = None,
) -> dict[str, DataFrame]:
    """Every section of the report.  The date reaches the table scans as a filter."""
    daily, minute = tables["usage_daily"], tables["usage_minute"]
    windows, sessions = tables["usage_window"], tables["usage_session"]
    date = selected_date(daily, wanted).first().date
    today = F.col("local_date") == F.lit(date)
    return {
        "current": current(feed, logs, minute, windows, capacities, now_ms),
        "account_daily_tokens": feed_daily_tokens(feed),
        "days": day_view(daily),
        "selected_day": day_view(daily.filter(today)),
        "selected_minutes": minute_view(minute.filter(today)),
        "selected_models": report_models(sessions.filter(today)),
        "selected_sessions": report_sessions(sessions.filter(today)),
        "selected_turns": report_turns(sessions.filter(today)),
        "quota_windows": window_detail(windows, minute, sessions),
        "window_minutes": minute_view(minute.filter("window_id is not null")),
        "window_sessions": report_sessions(
            sessions.filter("window_id is not null"), ["window_id"]
        ),
        "window_turns": report_turns(sessions.filter("window_id is not null")),
        "validation_latest": latest_run(external),
        "validation": validation(external, daily),
        "capacities": capacity_view(capacities),
        "methodology": methodology(credit, usd),
        "price_card": price_card(credit, usd),
        "audit": audit(daily, sessions, windows, logs, external),
    }


def report_document(sections: dict[str, DataFrame]) -> DataFrame:
    """The whole report as one table: a row per item, with its section and its JSON text.

    Fields without a value are written as null.  Items stay rows, since the
    sessions and minutes of a day have no bound.
    """
    parts = [
        section.select(
            F.lit(name).alias("section"),
            F.to_json(F.struct(*section.columns), {"ignoreNullFields": "false"}).alias("item"),
        )
        for name, section in sections.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def write_document(sections: dict[str, DataFrame], folder: str) -> None:
    """Write the report by one job, as JSON lines in a partition per section."""
    report_document(sections).write.mode("overwrite").partitionBy("section").text(folder)


def write_report(sections: dict[str, DataFrame], folder: str) -> None:
    """Write each section as JSON lines under its own folder."""
    for name, section in sections.items():
        section.write.mode("overwrite").json(f"{folder}/{name}")
