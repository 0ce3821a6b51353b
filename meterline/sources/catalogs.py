"""Price catalogs and capacities as small tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    CAPACITY_DEFAULTS,
    CREDIT_RATES,
    CREDIT_VERSIONS,
    USD_RATES,
    USD_VERSIONS,
)

_CARD = (
    "input_microusd_per_million bigint, cache_read_microusd_per_million bigint, "
    "cache_write_microusd_per_million bigint, output_microusd_per_million bigint"
)
CATALOG_SCHEMA = (
    "scheme string, catalog_version string, timezone string, versions array<struct<"
    "version string, effective_from_ms bigint, effective_to_ms bigint, "
    "long_context_threshold_tokens bigint, rates array<struct<"
    f"model string, aliases array<string>, {_CARD}, fast_multiplier double, "
    f"long_context struct<{_CARD}>>>>>"
)
CAPACITY_SCHEMA = (
    "profile_code string, account_key string, plan_type string, weekly_credit double, "
    "effective_from_ms bigint, effective_to_ms bigint, confirmed_at_ms bigint"
)
_CARD_NAMES = ["input", "cache_read", "cache_write", "output"]


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of configuration rows, planned as a one-row generator of known size."""
    parsed = F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{schema}>>"))
    return spark.range(1).select(F.inline(parsed))


def _long_form(document: DataFrame) -> DataFrame:
    """One row per version and rate, in catalog order."""
    version = document.select("scheme", F.posexplode("versions").alias("version_no", "v"))
    rate = version.select("scheme", "version_no", "v", F.posexplode("v.rates").alias("rate_no", "r"))
    card = [F.col(f"r.{n}_microusd_per_million").alias(f"{n}_rate") for n in _CARD_NAMES]
    long_card = [
        F.col(f"r.long_context.{n}_microusd_per_million").alias(f"long_{n}_rate")
        for n in _CARD_NAMES
    ]
    return rate.select(
        "scheme",
        "version_no",
        F.col("v.version").alias("version"),
        F.col("v.effective_from_ms").alias("effective_from_ms"),
        F.col("v.effective_to_ms").alias("effective_to_ms"),
        F.col("v.long_context_threshold_tokens").alias("threshold_tokens"),
        "rate_no",
        F.col("r.model").alias("model"),
        F.coalesce(F.col("r.aliases"), F.array().cast("array<string>")).alias("aliases"),
        *card,
        F.col("r.fast_multiplier").alias("fast_multiplier"),
        F.col("r.long_context").isNotNull().alias("has_long_context"),
        *long_card,
    )


def price_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Read one catalog document (scheme, versions, rates) from JSON."""
    return _long_form(spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path))


def _document(scheme: str, versions: list[tuple], rates: dict[str, list[tuple]]) -> dict:
    def card(values) -> dict:
        return {f"{n}_microusd_per_million": v for n, v in zip(_CARD_NAMES, values)}

    def rate(row: tuple) -> dict:
        model, aliases, *numbers = row
        long_card = numbers[5] if len(numbers) > 5 else None
        return {
            "model": model,
            "aliases": aliases,
            **card(numbers[:4]),
            "fast_multiplier": numbers[4],
            "long_context": card(long_card) if long_card else None,
        }

    return {
        "scheme": scheme,
        "versions": [
            {
                "version": name,
                "effective_from_ms": start,
                "effective_to_ms": end,
                "long_context_threshold_tokens": threshold,
                "rates": [rate(row) for row in rates[name]],
            }
            for name, start, end, threshold in versions
        ],
    }


def _built_in(spark: SparkSession, document: dict) -> DataFrame:
    parsed = F.from_json(F.lit(json.dumps(document)), F.lit(f"struct<{CATALOG_SCHEMA}>"))
    return _long_form(spark.range(1).select(F.inline(F.array(parsed))))


def credit_catalog(spark: SparkSession) -> DataFrame:
    """The published subscription credit catalog."""
    return _built_in(spark, _document("subscription_credit", CREDIT_VERSIONS, CREDIT_RATES))


def usd_catalog(spark: SparkSession) -> DataFrame:
    """The published API dollar catalog."""
    return _built_in(spark, _document("api_usd", USD_VERSIONS, USD_RATES))


def default_capacities(spark: SparkSession, defaults: dict | None = None) -> DataFrame:
    """Canonical capacity rows: no account, no plan, valid from 0."""
    rows = [
        {
            "profile_code": code,
            "account_key": None,
            "plan_type": None,
            "weekly_credit": credit,
            "effective_from_ms": 0,
            "effective_to_ms": None,
            "confirmed_at_ms": 0,
        }
        for code, credit in (defaults or CAPACITY_DEFAULTS).items()
    ]
    return small_table(spark, rows, CAPACITY_SCHEMA)


def _is_canonical():
    return (
        F.col("account_key").isNull()
        & F.col("plan_type").isNull()
        & (F.col("effective_from_ms") == 0)
    )


def current_capacities(capacities: DataFrame) -> DataFrame:
    """Only the canonical rows, the ones the rollups and the report read."""
    return capacities.filter(_is_canonical())


def ensure_capacities(capacities: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Seed missing canonical rows and promote the newest dated value over an untouched seed."""
    spark = capacities.sparkSession
    seeds = default_capacities(spark, defaults)
    newest = Window.partitionBy("profile_code").orderBy(
        F.col("confirmed_at_ms").desc(), F.col("effective_from_ms").desc()
    )
    dated = (
        capacities.filter(~_is_canonical())
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1")
        .select(
            "profile_code",
            F.col("weekly_credit").alias("dated_credit"),
            F.col("confirmed_at_ms").alias("dated_at_ms"),
        )
    )
    present = current_capacities(capacities)
    canonical = present.unionByName(
        seeds.join(present.select("profile_code"), "profile_code", "left_anti").select(
            *present.columns
        )
    )
    promote = (
        (F.col("confirmed_at_ms") == 0)
        & F.col("dated_credit").isNotNull()
        & F.col("profile_code").isin(*(defaults or CAPACITY_DEFAULTS))
    )
    settled = canonical.join(dated, "profile_code", "left").select(
        "profile_code",
        "account_key",
        "plan_type",
        F.when(promote, F.col("dated_credit")).otherwise(F.col("weekly_credit")).alias(
            "weekly_credit"
        ),
        "effective_from_ms",
        F.when(promote, F.lit(None).cast("bigint"))
        .otherwise(F.col("effective_to_ms"))
        .alias("effective_to_ms"),
        F.when(promote, F.col("dated_at_ms")).otherwise(F.col("confirmed_at_ms")).alias(
            "confirmed_at_ms"
        ),
    )
    return settled.unionByName(capacities.filter(~_is_canonical()).select(*settled.columns))


def set_capacity(
    capacities: DataFrame, profile_code: str, weekly_credit: float, now_ms: int
) -> DataFrame:
    """Set the canonical row of one profile; the rollups are rebuilt afterwards."""
    if profile_code not in CAPACITY_DEFAULTS:
        raise ValueError(f"unknown capacity profile: {profile_code}")
    if not 0 <= weekly_credit < float("inf"):
        raise ValueError("weekly credit must be a finite number, zero or more")
    row = small_table(
        capacities.sparkSession,
        [
            {
                "profile_code": profile_code,
                "weekly_credit": weekly_credit,
                "effective_from_ms": 0,
                "confirmed_at_ms": now_ms,
            }
        ],
        CAPACITY_SCHEMA,
    )
    others = capacities.filter(~(_is_canonical() & (F.col("profile_code") == profile_code)))
    return others.unionByName(row.select(*others.columns))
