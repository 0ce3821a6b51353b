"""Column lists and checks of the eight tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE_JSONL = (
    "source_key string, kind string, observed_at_ms bigint, last_seen_at_ms bigint, "
    "session_id string, parent_session_id string, root_session_id string, turn_id string, "
    "relation string, title string, started_at_ms bigint, ended_at_ms bigint, model string, "
    "service_tier string, reasoning_effort string, provider string, plan_type string, "
    "input_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, "
    "output_tokens bigint, reasoning_tokens bigint, total_tokens bigint, limit_id string, "
    "window_kind string, used_percent double, window_minutes bigint, resets_at_ms bigint, "
    "quality string"
)
SOURCE_APP_SERVER = (
    "source_key string, kind string, first_seen_at_ms bigint, last_seen_at_ms bigint, "
    "account_key string, account_label string, auth_kind string, provider string, "
    "plan_type string, limit_id string, window_kind string, used_percent double, "
    "window_minutes bigint, resets_at_ms bigint, lifetime_tokens bigint, "
    "daily_tokens_json string, freshness string, status string"
)
SOURCE_CCUSAGE = (
    "source_key string, run_at_ms bigint, range_start_ms bigint, range_end_ms bigint, "
    "scope string, scope_key string, pricing_scheme string, speed string, input_tokens bigint, "
    "cache_read_tokens bigint, cache_write_tokens bigint, output_tokens bigint, "
    "reasoning_tokens bigint, total_tokens bigint, amount double, model_breakdown_json string, "
    "ccusage_version string, pricing_version string, status string"
)


def column_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


# Enumerations by table; a null passes unless the column is required.
CHECKS = {
    "source_jsonl": {
        "kind": ["session", "turn", "usage", "quota"],
        "relation": ["main", "child", "fork", "unknown"],
    },
    "source_app_server": {
        "kind": ["account", "quota", "usage"],
        "freshness": ["pending", "stale", "settled", "unavailable"],
        "status": ["ok", "unavailable"],
    },
    "source_ccusage": {
        "scope": ["daily", "session"],
        "pricing_scheme": ["subscription", "api"],
        "speed": ["auto", "standard"],
        "status": ["ok", "failed", "incomparable"],
    },
    "usage_daily": {"account_token_freshness": ["pending", "stale", "settled", "unavailable"]},
    "usage_minute": {
        "window_kind": ["primary", "secondary", "unknown"],
        "official_source": ["app_server", "jsonl", "none"],
    },
    "usage_window": {"window_kind": ["primary", "secondary", "unknown"]},
    "usage_session": {
        "relation": ["main", "child", "fork", "unknown"],
        "fast_state": ["fast", "standard", "mixed", "unknown"],
    },
    "capacities": {"profile_code": ["usd20", "usd100", "usd200"]},
}


def checked(df: DataFrame, table: str) -> DataFrame:
    """Fail the job on a value outside its enumeration."""
    for column, allowed in CHECKS[table].items():
        bad = ~F.col(column).isin(*allowed)
        message = F.concat(F.lit(f"{table}.{column} is not allowed: "), F.col(column))
        df = df.withColumn(
            column, F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col(column))
        )
    return df
