"""Price events against two versioned rate catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import DAY_MS, EXACT_MODEL_SCORE
from ..functions import quality
from ..functions.accounts import dollars_per_token
from ..functions.storage import freeze

_BEGIN = -(2**63)
_NEVER = 2**63 - 1
_RATES = ["input", "cache_read", "cache_write", "output"]
# Token and rate sizes below which four products fit into 63 bits; above, decimals take over.
_SAFE_TOKENS = 500_000_000
_SAFE_RATE = 4_000_000_000
_VERSION = ["version", "version_no", "effective_from_ms", "effective_to_ms"]


def boundaries(credit: DataFrame, usd: DataFrame) -> DataFrame:
    """All instants at which either catalog changes."""
    both = credit.unionByName(usd)
    return (
        both.select(F.col("effective_from_ms").alias("at_ms"))
        .union(both.select("effective_to_ms").filter("effective_to_ms is not null"))
        .distinct()
    )


def version_at(times: DataFrame, at: str, catalog: DataFrame, name: str) -> DataFrame:
    """Add the version valid at ``at``; of overlapping versions the latest start wins.

    For few distinct times: the events go through ``price_segments``.
    """
    versions = catalog.select(*_VERSION).distinct()
    valid = (F.col("effective_from_ms") <= F.col(at)) & (
        F.col("effective_to_ms").isNull() | (F.col(at) < F.col("effective_to_ms"))
    )
    return (
        times.join(F.broadcast(versions), valid, "left")
        .groupBy(*times.columns)
        .agg(F.max_by("version", F.struct("effective_from_ms", "version_no")).alias(name))
    )


def price_segments(credit: DataFrame, usd: DataFrame) -> DataFrame:
    """The whole time axis cut into pieces with one version of each catalog.

    The number of pieces is bounded by the catalogs' versions, not by events.
    """
    spark = credit.sparkSession
    start = spark.range(1).select(F.lit(_BEGIN).cast("bigint").alias("at_ms"))
    points = boundaries(credit, usd).union(start).distinct()
    points = version_at(points, "at_ms", credit, "credit_version")
    points = version_at(points, "at_ms", usd, "usd_version")
    following = F.lead("at_ms").over(Window.orderBy("at_ms"))
    return points.select(
        F.col("at_ms").alias("segment_from_ms"),
        F.coalesce(following, F.lit(_NEVER)).alias("segment_to_ms"),
        "credit_version",
        "usd_version",
    )


def price_version_at(
    events: DataFrame, credit: DataFrame, usd: DataFrame, times: DataFrame | None = None
) -> DataFrame:
    """Add ``credit_version`` and ``usd_version`` by event time.

    Segments are laid out over the days that occur, one row per day and one more
    per change of price, so that events join on the day, with the time as residue.
    ``times`` is a cheaper frame with the same times, for events that are not frozen.
    """
    segments = price_segments(credit, usd)
    day_of = lambda ms: F.expr(f"({ms}) div {DAY_MS}L")  # noqa: E731  any monotone day will do
    day = day_of("observed_at_ms")
    days = (events if times is None else times).select(day.alias("_day")).distinct()
    # Days and segments are both few: calendar days, and changes of a price list.
    within = (day_of("segment_from_ms") <= F.col("_day")) & (F.col("_day") <= day_of("segment_to_ms - 1"))
    laid_out = freeze(days.join(segments, within), "price-day-segments")
    keyed = events.withColumn("_at_day", day)
    inside = (
        (keyed["_at_day"] == laid_out["_day"])
        & (keyed["observed_at_ms"] >= laid_out["segment_from_ms"])
        & (keyed["observed_at_ms"] < laid_out["segment_to_ms"])
    )
    return keyed.join(laid_out, inside, "left").select(*events.columns, "credit_version", "usd_version")


def match_rate(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """Best rate of every version for each lower-cased model name in ``model_key``.

    An exact name or alias beats any prefix, a longer prefix beats a shorter
    one, and the later catalog row wins a tie.  Call it on distinct names.
    """
    named = catalog.withColumn(
        "name", F.explode(F.concat(F.array(F.col("model")), F.col("aliases")))
    ).withColumn("name", F.lower("name"))
    fields = [c for c in catalog.columns if c not in ("scheme", "version", "version_no", "aliases")]
    # A prefix ends before a dash, so a key meets names by equality with its leading parts;
    # leading parts longer than every name are not formed.
    longest = named.agg(F.max(F.size(F.split("name", "-"))).alias("_most")).withColumn("_one", F.lit(1))
    parts = models.withColumns({"_one": F.lit(1), "_parts": F.split("model_key", "-")}).join(longest, "_one")
    shorter = F.transform(
        F.sequence(F.lit(1), F.least(F.size("_parts") - 1, F.col("_most"))),
        lambda n: F.array_join(F.slice("_parts", 1, n), "-"),
    )
    leading = F.when((F.size("_parts") > 1) & (F.col("_most") > 0), shorter).otherwise(F.array().cast("array<string>"))
    asked = parts.select("model_key", F.explode(F.array_append(leading, F.col("model_key"))).alias("name"))
    exact = F.col("model_key") == F.col("name")
    score = F.when(exact, F.lit(EXACT_MODEL_SCORE) + F.length("name")).otherwise(F.length("name"))
    best = F.max_by(F.struct(*fields), F.struct(score, F.col("rate_no")))
    return asked.join(named, "name").groupBy("model_key", "scheme", "version").agg(best.alias("rate"))


def _chosen_rate(rate: str, name: str) -> Column:
    """Long-context rate above the threshold, where the card has one."""
    return F.expr(
        f"if({rate}.threshold_tokens is not null and {rate}.has_long_context "
        f"and input_tokens > {rate}.threshold_tokens, {rate}.long_{name}_rate, {rate}.{name}_rate)"
    )


def _base_amount(side: str) -> Column:
    """Micros: the four products, plus half a million, over a million.

    Four products of ordinary size fit into 63 bits; larger ones are decimals.
    """
    counts = ["_fresh_input", "cache_read_tokens", "cache_write_tokens", "output_tokens"]
    rates = [f"{side}_{n}" for n in _RATES]

    def numerator(kind: str) -> str:
        products = [f"cast({c} as {kind}) * cast({r} as {kind})" for c, r in zip(counts, rates)]
        return " + ".join([*products, f"cast(500000 as {kind})"])

    wide = numerator("decimal(19,0)")
    rough = " + ".join(f"cast({c} as double) * cast({r} as double)" for c, r in zip(counts, rates))
    # Beyond a rough 1e25 the sum saturates for sure, below it the decimals cannot overflow.
    return F.expr(
        f"case when greatest({', '.join(counts)}) <= {_SAFE_TOKENS} "
        f"and greatest({', '.join(rates)}) <= {_SAFE_RATE} "
        f"then ({numerator('bigint')}) div 1000000L "
        f"when ({rough}) > 1e25D then {_NEVER}L "
        f"when ({wide}) >= cast({_NEVER} as decimal(19,0)) * 1000000 then {_NEVER}L "
        f"else ({wide}) div 1000000 end"
    )


def _multiplied(side: str) -> Column:
    """Round half away from zero; null when the multiplier cannot be used."""
    rate = f"{side}_rate.fast_multiplier"
    product = f"round(cast({side}_base as double) * {rate})"
    return F.expr(
        f"case when not _fast then {side}_base "
        f"when isnan({rate}) or {rate} < 0 or {rate} = double('infinity') then null "
        f"when {product} >= {float(_NEVER)!r}D then {_NEVER}L else cast({product} as bigint) end"
    )


def rate_card(events: DataFrame, credit: DataFrame, usd: DataFrame) -> DataFrame:
    """Rates of every model name that occurs, frozen so that its size is known."""
    models = (
        events.select(F.lower("model").alias("model_key")).filter("model_key is not null").distinct()
    )
    card = match_rate(models, credit).unionByName(match_rate(models, usd))
    return freeze(card, "rate-card")


def price_events(
    events: DataFrame,
    credit: DataFrame,
    usd: DataFrame,
    default_tier: str = "standard",
    card: DataFrame | None = None,
    times: DataFrame | None = None,
) -> DataFrame:
    """Add ``credit_micros``, ``api_usd_micros`` and the ``price_flags`` mask.

    Both amounts are null when either catalog has no rate for the model.
    ``card`` is a ``rate_card`` that covers the events' models, ``times`` a frozen
    frame with the events' times.
    """
    if card is None:
        card = rate_card(events, credit, usd)

    def side(scheme: str, version: str, rate: str) -> DataFrame:
        return card.filter(F.col("scheme") == scheme).select(
            F.col("model_key"), F.col("version").alias(version), F.col("rate").alias(rate)
        )

    classified = "coalesce(service_tier in ('fast', 'standard'), false)"
    default_fast = "true" if default_tier == "fast" else "false"
    joined = (
        price_version_at(events.withColumn("model_key", F.lower("model")), credit, usd, times)
        .join(
            side("subscription_credit", "credit_version", "credit_rate"),
            ["model_key", "credit_version"],
            "left",
        )
        .join(side("api_usd", "usd_version", "usd_rate"), ["model_key", "usd_version"], "left")
        .withColumns(
            {
                "_fresh_input": F.expr("greatest(input_tokens - cache_read_tokens, 0L)"),
                "_wants_fast": F.expr(
                    f"if({classified}, service_tier = 'fast', {default_fast})"
                ),
                "_multipliers": F.expr(
                    "credit_rate.fast_multiplier is not null "
                    "and usd_rate.fast_multiplier is not null"
                ),
                "_priced": F.expr("credit_rate is not null and usd_rate is not null"),
                **{f"credit_{n}": _chosen_rate("credit_rate", n) for n in _RATES},
                **{f"usd_{n}": _chosen_rate("usd_rate", n) for n in _RATES},
            }
        )
    )
    amounts = joined.withColumns(
        {
            "_fast": F.expr("_wants_fast and _multipliers"),
            "credit_base": _base_amount("credit"),
            "usd_base": _base_amount("usd"),
        }
    ).withColumns({"_credit": _multiplied("credit"), "_usd": _multiplied("usd")})
    bits = quality.BITS
    flags = F.expr(
        f"case when model is null then {bits['missing_pricing']} "
        f"when credit_version is null then {bits['missing_subscription_version']} "
        f"when usd_version is null then {bits['missing_api_version']} "
        f"when not _priced then {bits['missing_pricing']} "
        f"when _credit is null or _usd is null then {bits['pricing_multiplier_invalid']} "
        f"else if({classified}, 0, {bits['service_tier_unclassified']}) | "
        f"if(_wants_fast and not _multipliers, {bits['fast_unsupported_fallback_standard']}, 0) end"
    )
    known = "_priced and _credit is not null and _usd is not null"
    return amounts.select(
        *events.columns,
        "credit_version",
        "usd_version",
        F.expr(f"if({known}, _credit, null)").alias("credit_micros"),
        F.expr(f"if({known}, _usd, null)").alias("api_usd_micros"),
        flags.alias("price_flags"),
    )


def price_card(credit: DataFrame, usd: DataFrame) -> DataFrame:
    """Both catalogs side by side, one row per period and credit model."""
    points = boundaries(credit, usd)
    following = F.lead("at_ms").over(Window.orderBy("at_ms"))
    periods = points.select(
        F.col("at_ms").alias("effective_from_ms"), following.alias("effective_to_ms")
    )
    periods = version_at(periods.withColumnRenamed("effective_from_ms", "from_ms")
                         .withColumnRenamed("effective_to_ms", "to_ms"),
                         "from_ms", credit, "credit_version")
    periods = version_at(periods, "from_ms", usd, "usd_version")
    periods = periods.filter("credit_version is not null and usd_version is not null")
    names = credit.select(F.lower("model").alias("model_key")).distinct()
    matched = match_rate(names, usd).select(
        "model_key", F.col("version").alias("usd_version"), F.col("rate").alias("usd_rate")
    )
    left = credit.select(
        F.lower("model").alias("model_key"),
        F.col("version").alias("credit_version"),
        "rate_no",
        "model",
        *[F.col(f"{n}_rate").alias(f"credit_{n}") for n in _RATES],
        F.col("fast_multiplier").alias("credit_fast_multiplier"),
    )
    return (
        periods.join(left, "credit_version")
        .join(matched, ["model_key", "usd_version"], "left")
        .select(
            F.concat("credit_version", F.lit(" + "), "usd_version").alias("version"),
            F.col("from_ms").alias("effective_from_ms"),
            F.col("to_ms").alias("effective_to_ms"),
            "rate_no",
            "model",
            *[F.col(f"credit_{n}") for n in _RATES],
            "credit_fast_multiplier",
            *[F.col(f"usd_rate.{n}_rate").alias(f"usd_{n}") for n in _RATES],
            F.col("usd_rate.fast_multiplier").alias("usd_fast_multiplier"),
            *[F.col(f"usd_rate.long_{n}_rate").alias(f"usd_long_{n}") for n in _RATES],
        )
    )


def latest_version(catalog: DataFrame) -> DataFrame:
    """The version with the greatest start."""
    return catalog.agg(
        F.max_by("version", F.struct("effective_from_ms", "version_no")).alias("version")
    )


def pricing_version(credit: DataFrame, usd: DataFrame) -> DataFrame:
    """Latest credit and dollar versions joined by ``+``."""
    tagged = latest_version(credit).select(F.lit(0).alias("place"), "version").union(
        latest_version(usd).select(F.lit(1), "version")
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", F.coalesce("version", F.lit("missing")))))
    return tagged.agg(
        F.array_join(F.transform(ordered, lambda s: s["col2"]), "+").alias("pricing_version")
    )


def rate_overrides(catalog: DataFrame, at_ms: int | None = None) -> DataFrame:
    """Dollars per token by model and alias, of the latest version or the one at a time."""
    if at_ms is None:
        chosen = latest_version(catalog)
    else:
        at = catalog.sparkSession.range(1).select(F.lit(at_ms).cast("bigint").alias("at_ms"))
        chosen = version_at(at, "at_ms", catalog, "version").select("version")
    rows = catalog.join(F.broadcast(chosen), "version", "left_semi")
    names = F.explode(F.array_union(F.array(F.col("model")), F.col("aliases")))
    return rows.select(
        names.alias("model"),
        dollars_per_token(F.col("input_rate")).alias("input_cost_per_token"),
        dollars_per_token(F.col("cache_read_rate")).alias("cache_read_cost_per_token"),
        dollars_per_token(F.col("cache_write_rate")).alias("cache_write_cost_per_token"),
        dollars_per_token(F.col("output_rate")).alias("output_cost_per_token"),
        "fast_multiplier",
    )
