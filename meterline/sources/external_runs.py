"""Results of the independent recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_fields as j
from ..schemas import SOURCE_CCUSAGE
from .account_feed import sanitize_json

# Alias keys of an external row.
_TOKENS = {
    "input_tokens": ["inputTokens", "input_tokens"],
    "cache_read_tokens": ["cacheReadTokens", "cache_read_tokens"],
    "cache_write_tokens": ["cacheCreationTokens", "cacheWriteTokens", "cache_write_tokens"],
    "output_tokens": ["outputTokens", "output_tokens"],
    "reasoning_tokens": ["reasoningOutputTokens", "reasoning_tokens"],
    "total_tokens": ["totalTokens", "total_tokens"],
}


def external_usage(results: DataFrame, pricing_version: str | None = None) -> DataFrame:
    """One row per day or session of each run; a run without rows leaves one ``__run__`` row.

    ``results`` has scope, pricing_scheme, speed, started_at_ms,
    finished_at_ms, version, status and the JSON text ``data``.
    """
    listed = (
        f"case scope when 'daily' then {j.path('d', 'daily')} "
        f"when 'session' then {j.path('d', 'sessions')} end"
    )
    each = (
        results.withColumn("d", F.try_parse_json("data"))
        .withColumn("listed", F.expr(listed))
        .withColumn(
            "items",
            F.expr(
                "if(schema_of_variant(listed) like 'ARRAY%', "
                "try_variant_get(listed, '$', 'array<variant>'), null)"
            ),
        )
        .select("*", F.posexplode_outer("items").alias("item_no", "i"))
    )
    key = (
        f"case when item_no is null then '__run__' when scope = 'daily' then "
        f"coalesce({j.string(j.path('i', 'date'))}, 'unknown') else "
        f"coalesce({j.string(j.first_of('i', 'sessionId', 'session_id'))}, 'unknown') end"
    )
    shaped = each.withColumn("scope_key", F.expr(key))
    columns = {
        "source_key": F.concat_ws(
            ":", F.lit("ccusage"), "started_at_ms", "scope", "scope_key", "pricing_scheme", "speed"
        ),
        "run_at_ms": F.col("finished_at_ms"),
        "range_start_ms": F.col("started_at_ms"),
        "range_end_ms": F.col("finished_at_ms"),
        **{n: F.col(n) for n in ("scope", "scope_key", "pricing_scheme", "speed", "status")},
        **{n: F.expr(j.integer(j.first_of("i", *keys))) for n, keys in _TOKENS.items()},
        "amount": F.expr(j.double(j.first_of("i", "costUSD", "amount"))),
        "model_breakdown_json": sanitize_json(F.to_json(F.expr(j.path("i", "models")))),
        "ccusage_version": F.col("version"),
        "pricing_version": F.lit(pricing_version),
    }
    cells = []
    for part in SOURCE_CCUSAGE.split(", "):
        name, type_name = part.split()
        cells.append(columns[name].cast(type_name).alias(name))
    return shaped.select(*cells, F.coalesce("item_no", F.lit(0)).alias("item_no"))


def run_status(results: DataFrame) -> DataFrame:
    """ok when every run succeeded, failed when none did, else partial."""
    good = F.count_if(F.col("status") == "ok")
    total = F.count(F.lit(1))
    return results.agg(
        total.alias("runs"),
        good.alias("succeeded"),
        F.when(good == total, F.lit("ok"))
        .when(good == 0, F.lit("failed"))
        .otherwise(F.lit("partial"))
        .alias("status"),
    )
