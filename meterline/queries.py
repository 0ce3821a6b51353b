"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters
from .functions import accounts, quality, timeline
from .functions.accounts import coverage_ratio, unobserved_tokens
from .functions.ordered import CHUNK, Running, ordered_scan, range_chunks
from .functions.storage import freeze, keep, scratch, scratch_path
from .functions.timeline import local_date
from .functions.tokens import TOKEN_COLUMNS, normalize_tokens, token_struct
from .operators import capacity, dedupe, lineage, pricing, replay, turns, windows
from .plans import report, rollup
from .plans.from_facts import inputs_from_facts
from .plans.recompute import LiveRollups
from .schemas import SOURCE_APP_SERVER, SOURCE_CCUSAGE, SOURCE_JSONL
from .sources import account_feed, external_runs, landed, upserts
from .sources import session_logs as logs
from .sources.catalogs import (
    CAPACITY_SCHEMA,
    credit_catalog,
    default_capacities,
    ensure_capacities,
    set_capacity,
    small_table,
    usd_catalog,
)
from .sources.keyed_store import KeyedStore
from .streaming import reset_windows as live_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rollups(spark: SparkSession, sf_dir: str) -> rollup.Rollups:
    return rollup.Rollups(adapters.rollup_inputs(spark, sf_dir))


def _catalogs(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return credit_catalog(spark), usd_catalog(spark)


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_tokens(adapters.usage_raw(spark, sf_dir))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_usage(rollup.usage_records(adapters.usage_raw(spark, sf_dir)))


# --- tokens, pricing -------------------------------------------------------


@query
def usage_normalized(spark, sf_dir):
    raw = adapters.usage_raw(spark, sf_dir).withColumns(
        {
            "input_tokens": F.col("input_tokens") - 5000,
            "cache_read_tokens": F.col("cache_read_tokens") * 2,
            "cache_write_tokens": F.col("cache_write_tokens") - 3,
            "reasoning_tokens": F.col("reasoning_tokens") * 3,
            "total_tokens": F.when(F.col("service_tier") == "fast", F.lit(0)).otherwise(
                F.col("total_tokens")
            ),
        }
    )
    return normalize_tokens(raw).select("source_key", *TOKEN_COLUMNS)


@query
def usage_dedup(spark, sf_dir):
    return _counted(spark, sf_dir)


@query
def price_version_at(spark, sf_dir):
    usage = adapters.usage_raw(spark, sf_dir).select("source_key", "observed_at_ms")
    return pricing.price_version_at(usage, *_catalogs(spark)).drop("observed_at_ms")


@query
def match_rate(spark, sf_dir):
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", F.lit("GPT-5.6-Sol"))
        .when(kind == "view", F.lit("gpt-5.5-cyber"))
        .when(kind == "purchase", F.lit("gpt-5.4-mini"))
        .when(kind == "signup", F.lit("codex-auto-review"))
        .otherwise(F.lit("gpt-5"))
    )
    k = F.get_json_object("props", "$.k").cast("bigint")
    suffix = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), k))
    names = (
        adapters.table(spark, sf_dir, "events")
        .select(F.lower(F.concat(name, suffix)).alias("model_key"))
        .distinct()
    )
    credit, usd = _catalogs(spark)
    return (
        pricing.match_rate(names, credit)
        .unionByName(pricing.match_rate(names, usd))
        .select(
            "model_key",
            "scheme",
            "version",
            F.col("rate.model").alias("matched_model"),
            F.col("rate.input_rate").alias("input_rate"),
        )
    )


@query
def price_events(spark, sf_dir):
    return pricing.price_events(_usage(spark, sf_dir), *_catalogs(spark)).select(
        "source_key", "credit_micros", "api_usd_micros", quality.text("price_flags").alias("quality")
    )


@query
def price_card(spark, sf_dir):
    """Both catalogs side by side, with the events that each line prices."""
    credit, usd = _catalogs(spark)
    usage = pricing.price_version_at(_usage(spark, sf_dir), credit, usd)
    card = pricing.rate_card(usage, credit, usd)

    def side(scheme: str, version: str) -> DataFrame:
        return card.filter(F.col("scheme") == scheme).select(
            "model_key",
            F.col("version").alias(version),
            F.col("rate.model").alias(f"{version}_model"),
        )

    used = (
        usage.withColumn("model_key", F.lower("model"))
        .join(side("subscription_credit", "credit_version"), ["model_key", "credit_version"])
        .groupBy(
            F.concat("credit_version", F.lit(" + "), "usd_version").alias("version"),
            F.col("credit_version_model").alias("model"),
        )
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return (
        pricing.price_card(credit, usd)
        .join(used, ["version", "model"], "left")
        .select(
            "version",
            "effective_from_ms",
            "effective_to_ms",
            "model",
            "credit_input",
            "credit_output",
            "credit_fast_multiplier",
            "usd_input",
            "usd_output",
            "usd_fast_multiplier",
            "usd_long_input",
            F.coalesce("events", F.lit(0)).cast("bigint").alias("events"),
        )
    )


@query
def rate_overrides(spark, sf_dir):
    """Cost of each exactly named model at the latest dollars-per-token overrides."""
    rates = pricing.rate_overrides(usd_catalog(spark))
    totals = (
        _usage(spark, sf_dir)
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum(F.col("input_tokens") - F.col("cache_read_tokens")).alias("input"),
            *[F.sum(f"{n}_tokens").alias(n) for n in ("cache_read", "cache_write", "output")],
        )
    )
    return totals.join(F.broadcast(rates), "model").select(
        "model",
        "events",
        *[
            (F.col(n) * F.col(f"{n}_cost_per_token")).alias(f"{n}_cost")
            for n in ("input", "cache_read", "cache_write", "output")
        ],
        "fast_multiplier",
    )


@query
def pricing_version(spark, sf_dir):
    one = F.lit(1).alias("one")
    version = pricing.pricing_version(*_catalogs(spark)).select(one, "pricing_version")
    days = adapters.usage_raw(spark, sf_dir).groupBy(local_date(F.col("observed_at_ms")).alias("local_date")).agg(
        F.count(F.lit(1)).alias("events")
    )
    return days.select("*", one).join(version, "one").drop("one")


@query
def price_boundaries(spark, sf_dir):
    """Events before each instant at which a catalog changes: running counts on one line of events and instants."""
    points = pricing.boundaries(*_catalogs(spark)).select(F.col("at_ms"), F.lit(0).alias("side"), F.lit("").alias("tie"))
    usage = adapters.usage_raw(spark, sf_dir).select(F.col("observed_at_ms").alias("at_ms"), F.lit(1).alias("side"), F.col("source_key").alias("tie"))
    order = ["at_ms", "side", "tie"]
    line = range_chunks(points.unionByName(usage).withColumn("all", F.lit(0)), ["all"], order, "boundary-line")
    counted = ordered_scan(line, ["all"], order, [Running("events_before", "sum", F.col("side").cast("bigint"))])
    return counted.filter("side = 0").select("at_ms", "events_before")


@query
def quality_union(spark, sf_dir):
    priced = pricing.price_events(_usage(spark, sf_dir), *_catalogs(spark))
    return (
        priced.groupBy("session_id")
        .agg(F.bit_or("price_flags").alias("flags"))
        .select("session_id", quality.text("flags").alias("quality"))
    )


# --- windows ---------------------------------------------------------------


def _quota(spark, sf_dir):
    return windows.canonical_limit(adapters.quota_raw(spark, sf_dir))


@query
def canonical_limit(spark, sf_dir):
    return _quota(spark, sf_dir)


@query
def reset_windows(spark, sf_dir):
    return windows.reset_windows(_quota(spark, sf_dir)).drop("quota_group")


@query
def reset_windows_live(spark, sf_dir):
    """The same windows from a stream that reads the observations in shuffled parts."""
    folder, out = scratch_path(spark, "quota-stream"), scratch_path(spark, "windows-stream")
    quota = _quota(spark, sf_dir)
    quota.repartition(4, F.xxhash64("source_key")).write.parquet(folder)
    # Rows of another group, far ahead, move the watermark past all observations.
    latest = quota.agg(F.max("first_seen_at_ms")).first()[0]
    for step in (1, 2):
        ahead = quota.limit(1).withColumns({"account_key": F.lit(""), "source_key": F.lit(""), "first_seen_at_ms": F.lit(latest + step * 4_000_000_000_000)})
        ahead.select(*quota.columns).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(quota.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # The delay is longer than all observations span: no part comes late.
        changes = live_windows.reset_window_stream(stream, "20000 days")
        running = (
            changes.writeStream.outputMode("update")
            .foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}"))
            .option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    found = live_windows.latest_windows(spark.read.schema(f"{live_windows.OUTPUT}, batch int").parquet(out).drop("batch"))
    return found.filter("account_key <> ''").drop("quota_group", "closed", "version")


@query
def disjoint_windows(spark, sf_dir):
    found = windows.reset_windows(_quota(spark, sf_dir))
    return windows.disjoint_windows(found).drop("quota_group")


@query
def usage_window_asof(spark, sf_dir):
    found = rollup.build_windows(_quota(spark, sf_dir))
    moments = rollup.usage_records(adapters.usage_raw(spark, sf_dir))
    return windows.usage_window(_counted(spark, sf_dir), found, moments).select("source_key", "window_id")


@query
def asof_by_account(spark, sf_dir):
    """Events on the lines of their own user's and of all users' windows; each error starts a window."""
    seen = adapters.events(spark, sf_dir).select(
        "event_id",
        F.col("user_id").cast("string").alias("account_key"),
        F.col("observed_at_ms").alias("at_ms"),
        "event_type",
    )
    started = seen.filter("event_type = 'error'").select(
        F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("window_id"),
        "account_key",
        F.col("at_ms").alias("window_start_ms"),
        F.col("account_key").alias("quota_group"),
        F.col("event_id").alias("ordinal"),
    )
    own = windows.assign_asof(seen, "at_ms", started, ["account_key"]).withColumnRenamed("window_id", "own_window_id")
    return windows.assign_asof(own, "at_ms", started, [], seen).select("event_id", "own_window_id", "window_id")


def _windowed_quota(spark, sf_dir):
    quota = _quota(spark, sf_dir)
    found = rollup.build_windows(quota)
    return windows.quota_window(quota, found), found


@query
def quota_window(spark, sf_dir):
    return _windowed_quota(spark, sf_dir)[0].select("source_key", "window_id")


@query
def official_point(spark, sf_dir):
    return windows.official_points(_windowed_quota(spark, sf_dir)[0]).drop(
        "quota_account_key", "quota_plan_type"
    )


@query
def official_delta(spark, sf_dir):
    points = windows.official_points(_windowed_quota(spark, sf_dir)[0])
    return windows.official_delta(
        points.filter("official_used_percent is not null and window_id is not null"), ["window_id"]
    )


@query
def reset_count(spark, sf_dir):
    rows, found = _windowed_quota(spark, sf_dir)
    return rollup.official_days(windows.official_points(rows), found).select(
        "local_date", "reset_count"
    )


@query
def usage_turn(spark, sf_dir):
    counted = freeze(_counted(spark, sf_dir), "counted")
    return turns.assign_turn(counted, adapters.turn_raw(spark, sf_dir)).select(
        "source_key", "turn_id", "turn_started_ms", "turn_ended_ms"
    )


# --- rollups ---------------------------------------------------------------


@query
def usage_daily(spark, sf_dir):
    return _rollups(spark, sf_dir).daily


def _inputs_of(spark, log_facts, feed):
    return inputs_from_facts(log_facts, feed, default_capacities(spark), *_catalogs(spark))


@query
def daily_from_facts(spark, sf_dir):
    """The daily table from the two fact tables."""
    log_facts = freeze(adapters.log_fact_table(spark, sf_dir), "log-facts")
    feed = freeze(adapters.feed_fact_table(spark, sf_dir), "feed-facts")
    return rollup.Rollups(_inputs_of(spark, log_facts, feed)).daily


@query
def daily_refreshed(spark, sf_dir):
    """The daily table after a second batch that holds late rows: only touched dates are computed again."""
    root = scratch_path(spark, "live")
    log_facts = freeze(adapters.log_fact_table(spark, sf_dir), "log-facts")
    feed = freeze(adapters.feed_fact_table(spark, sf_dir), "feed-facts")
    store = KeyedStore(spark, f"{root}/facts", SOURCE_JSONL, "source_key", upserts.upsert_logs, buckets=8)
    live = LiveRollups(spark, f"{root}/usage")
    mark = log_facts.filter("kind = 'usage'").agg(F.expr("percentile(observed_at_ms, 0.9)").cast("bigint")).first()[0]
    # A few rows of all days come with those of the last ones.
    second = (F.col("observed_at_ms") >= mark) | (F.crc32("source_key") % 500 == 0)
    for number, part in enumerate((~second, second)):
        with scratch(spark):
            changes = store.merge(log_facts.filter(part), ["observed_at_ms", "source_key"], number)
            # Usage, turns, sessions and quota are read from it many times; a first batch lies as it was merged.
            facts = freeze(store.read(), "facts") if number else store.read()
            live.refresh(_inputs_of(spark, facts, feed), changes)
    return live.table("usage_daily")


@query
def usage_minute(spark, sf_dir):
    return _rollups(spark, sf_dir).minute


@query
def usage_window(spark, sf_dir):
    return _rollups(spark, sf_dir).window


@query
def usage_session(spark, sf_dir):
    return _rollups(spark, sf_dir).session.drop("model_breakdown_json")


@query
def model_breakdown(spark, sf_dir):
    return rollup.model_breakdown(_rollups(spark, sf_dir).models)


@query
def dominant_plan(spark, sf_dir):
    split = rollup.plan_split(_rollups(spark, sf_dir).cube, ["local_date"])
    return rollup.dominant_plan(split, ["local_date"]).select(
        "local_date",
        "plan_type",
        F.col("local_plan.capacity_profile").alias("local_profile"),
        F.col("local_plan.credit_micros").alias("local_credit_micros"),
        "total_tokens",
        "credit_micros",
    )


@query
def window_account_tokens(spark, sf_dir):
    found = rollup.build_windows(_quota(spark, sf_dir))
    return rollup.window_account_tokens(found, adapters.account_days(spark, sf_dir))


@query
def session_official(spark, sf_dir):
    return _rollups(spark, sf_dir).session.select(
        "row_key", "official_percent_start", "official_percent_end"
    )


@query
def usage_session_meta(spark, sf_dir):
    return rollup.session_meta(
        _counted(spark, sf_dir), adapters.session_raw(spark, sf_dir)
    ).select("source_key", "title", "relation")


@query
def day_account_tokens(spark, sf_dir):
    days = (
        adapters.usage_raw(spark, sf_dir)
        .groupBy(local_date(F.col("observed_at_ms")).alias("local_date"))
        .agg(F.sum("total_tokens").alias("total_tokens"))
    )
    joined = rollup.day_account_tokens(days, adapters.account_days(spark, sf_dir))
    return joined.select(
        "local_date",
        "total_tokens",
        "account_tokens",
        unobserved_tokens(F.col("account_tokens"), F.col("total_tokens")).alias("unobserved_tokens"),
        coverage_ratio(F.col("account_tokens"), F.col("total_tokens")).alias("coverage_ratio"),
        "account_token_freshness",
    )


# --- logs ------------------------------------------------------------------


def _context(spark, sf_dir):
    envelopes = logs.parse_envelope(adapters.log_lines(spark, sf_dir))
    fields = freeze(logs.line_fields(envelopes), "log-fields", wide=True)
    return freeze(logs.carry_context(fields), "log-carried", wide=True)


@query
def file_header(spark, sf_dir):
    return logs.file_header(logs.parse_envelope(adapters.log_lines(spark, sf_dir)))


@query
def session_facts(spark, sf_dir):
    return logs.session_facts(_context(spark, sf_dir)).select(
        "source_key",
        "observed_at_ms",
        "session_id",
        "parent_session_id",
        "relation",
        "reasoning_effort",
        "provider",
        "plan_type",
        "quality",
    )


@query
def turn_facts(spark, sf_dir):
    return logs.turn_facts(_context(spark, sf_dir)).select(
        "source_key",
        "observed_at_ms",
        "session_id",
        "turn_id",
        "started_at_ms",
        "ended_at_ms",
        "model",
        "service_tier",
        "reasoning_effort",
        "plan_type",
        "quality",
    )


@query
def usage_facts(spark, sf_dir):
    return logs.usage_facts(_context(spark, sf_dir)).select(
        "observed_at_ms",
        "session_id",
        "turn_id",
        "relation",
        "model",
        "service_tier",
        "reasoning_effort",
        "plan_type",
        "input_tokens",
        "cache_read_tokens",
        "output_tokens",
        "total_tokens",
        "quality",
    )


@query
def quota_facts(spark, sf_dir):
    return logs.quota_facts(_context(spark, sf_dir)).select(
        "observed_at_ms",
        "plan_type",
        "limit_id",
        "window_kind",
        "used_percent",
        "window_minutes",
        "resets_at_ms",
    )


@query
def carry_context(spark, sf_dir):
    return _context(spark, sf_dir).select(
        "line_no",
        "session_id",
        "turn_id",
        F.col("tier.tier").alias("service_tier"),
        "model",
        F.col("effort").alias("reasoning_effort"),
        F.col("plan").alias("plan_type"),
    )


@query
def usage_digest(spark, sf_dir):
    return logs.usage_facts(_context(spark, sf_dir)).agg(
        F.count_distinct("source_key").alias("keys"), F.count(F.lit(1)).alias("events")
    )


@query
def usage_delta(spark, sf_dir):
    def counts(inp, out):
        zero = F.lit(0).cast("bigint")
        return token_struct(
            {
                "input_tokens": inp,
                "cache_read_tokens": zero,
                "cache_write_tokens": zero,
                "output_tokens": out,
                "reasoning_tokens": zero,
                "total_tokens": inp + out,
            }
        )

    shown = F.col("last_input") + F.col("last_output") > 0
    rows = adapters.cumulative_raw(spark, sf_dir).select(
        "user_id",
        "event_id",
        "repeat",
        F.call_function("div", F.col("event_id"), F.lit(1000).cast("bigint")).alias(CHUNK),
        counts(F.col("cum_input"), F.col("cum_output")).alias("cumulative"),
        F.when(shown, counts(F.col("last_input"), F.col("last_output"))).alias("last_usage"),
    )
    scanned = ordered_scan(
        rows,
        ["user_id"],
        ["event_id", "repeat"],
        [Running("previous", "last", F.col("cumulative"), before=True)],
    )
    tokens, note = logs.usage_delta(F.col("last_usage"), F.col("cumulative"), F.col("previous"))
    return scanned.select(
        "user_id",
        "event_id",
        "repeat",
        tokens.getField("input_tokens").alias("input_tokens"),
        tokens.getField("output_tokens").alias("output_tokens"),
        note.alias("quality"),
    )


# --- lineage and replay ----------------------------------------------------


def _user_edges(spark, sf_dir):
    user = F.col("user_id")
    return (
        adapters.table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .filter(user >= 50)
        .select(
            F.concat(F.lit("s"), user).alias("session_id"),
            F.concat(F.lit("s"), user - 50).alias("parent_session_id"),
        )
    )


@query
def resolve_root(spark, sf_dir):
    """Chains of users fifty apart, and rings that have no root."""
    ring = (
        adapters.table(spark, sf_dir, "events")
        .select((F.col("user_id") % 7).alias("n"))
        .distinct()
        .select(
            F.concat(F.lit("c"), "n").alias("session_id"),
            F.concat(F.lit("c"), (F.col("n") + 1) % 7).alias("parent_session_id"),
        )
    )
    return lineage.resolve_roots(_user_edges(spark, sf_dir).unionByName(ring))


@query
def parent_edges(spark, sf_dir):
    user = F.col("user_id")
    users = adapters.table(spark, sf_dir, "events").select("user_id").distinct()
    session = F.concat(F.lit("s"), user).alias("session_id")
    metadata = users.select(
        session, F.concat(F.lit("meta"), user % 5).alias("parent_session_id")
    )
    headers = users.filter((user % 3 == 0) & (user >= 50)).select(
        session,
        F.concat(F.lit("s"), user - 50).alias("parent_session_id"),
        F.concat(F.lit("p"), user).alias("path"),
    )
    return lineage.parent_edges(metadata, headers)


@query
def enrich_records(spark, sf_dir):
    """Usage without parents gets them from the graph, and effort from metadata."""
    raw = adapters.usage_raw(spark, sf_dir)
    records = raw.withColumns(
        {
            "kind": F.lit("usage"),
            "title": F.lit(None).cast("string"),
            "quality": F.lit(None).cast("string"),
            "relation": F.lit("main"),
            "parent_session_id": F.lit(None).cast("string"),
            "root_session_id": F.lit(None).cast("string"),
        }
    )
    metadata = (
        raw.select("session_id")
        .distinct()
        .select(
            "session_id",
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("string").alias("parent_session_id"),
            F.lit("low").alias("reasoning_effort"),
        )
    )
    return lineage.enrich(records, metadata, _user_edges(spark, sf_dir)).select(
        "source_key", "root_session_id", "parent_session_id", "reasoning_effort", "relation"
    )


@query
def replay_prefix(spark, sf_dir):
    return replay.replayed_usage(*adapters.replay_raw(spark, sf_dir)).drop("block")


@query
def leading_burst(spark, sf_dir):
    usage, _ = adapters.replay_raw(spark, sf_dir)
    return replay.leading_burst(replay.number_events(usage))


@query
def replayed_quota_drop(spark, sf_dir):
    usage, headers = adapters.replay_raw(spark, sf_dir)
    facts = usage.withColumn("kind", F.lit("usage"))
    quota = facts.filter(F.col("line_no") % 2 == 0).withColumn("kind", F.lit("quota"))
    return replay.strip_replay(facts.unionByName(quota), headers).select("path", "kind", "line_no")


# --- keyed writes ----------------------------------------------------------


def _halves(batch):
    """The rows that are stored before the batch, and those of the batch."""
    last = batch.agg(F.max("seq")).first()[0] or 0
    return batch.filter(F.col("seq") * 2 < last), batch.filter(F.col("seq") * 2 >= last)


@query
def log_upsert(spark, sf_dir):
    earlier, later = _halves(adapters.log_batch(spark, sf_dir))
    merged = upserts.upsert_logs(upserts.upsert_logs(None, earlier, ["seq"]), later, ["seq"])
    return merged.select(
        "source_key",
        "kind",
        "observed_at_ms",
        "last_seen_at_ms",
        "session_id",
        "model",
        "plan_type",
        "total_tokens",
        "used_percent",
        "title",
    )


_MERGED = ["source_key", "kind", "observed_at_ms", "last_seen_at_ms", "session_id", "model", "plan_type", "total_tokens", "used_percent", "title"]


@query
def log_upsert_batches(spark, sf_dir):
    """The merged table after four batches of a keyed store, the third of them twice."""
    batch = freeze(adapters.log_batch(spark, sf_dir), "log-batch")
    store = KeyedStore(spark, scratch_path(spark, "store"), SOURCE_JSONL, "source_key", upserts.upsert_logs, buckets=8, fan=2)
    last = batch.agg(F.max("seq")).first()[0]
    for number in (0, 1, 2, 2, 3):
        part = batch.filter(F.floor(F.col("seq") * 4 / (last + 1)) == number)
        store.merge(freeze(part, "batch"), ["seq"], number)
    return store.read().select(*_MERGED)


@query
def prune_files(spark, sf_dir):
    """Files that may hold facts of the last 29 days."""
    files = freeze(adapters.log_file_table(spark, sf_dir), "files")
    headers = files.filter("user_id % 2 = 0").select("path", F.col("first_ms").alias("forked_at_ms"))
    tracked = files.filter("user_id % 17 = 0").select("path")
    latest = adapters.events(spark, sf_dir).agg(F.max("observed_at_ms")).first()[0]
    return logs.prune_files(files, headers, logs.default_from_date(latest), tracked).select("path", "modified_ms")


@query
def filter_from(spark, sf_dir):
    """Usage of the last 29 days."""
    usage = adapters.usage_raw(spark, sf_dir)
    latest = usage.agg(F.max("observed_at_ms")).first()[0]
    return logs.filter_from(usage, logs.default_from_date(latest)).select("source_key", "observed_at_ms")


def _thread_tables(spark, sf_dir):
    """Titles of two conversations' lines per session, thread rows, and edges to parents."""
    lines = adapters.table(spark, sf_dir, "conversations")
    index = lines.select(
        F.when(F.col("conv_id") % 11 != 0, F.concat(F.lit("s"), F.col("conv_id") % 400)).alias("id"),
        F.when(F.col("turn") % 2 == 1, F.substring("text", 1, 40)).otherwise(F.lit("  ")).alias("thread_name"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"),
    )
    users = adapters.table(spark, sf_dir, "events").select("user_id").distinct()
    own = F.concat(F.lit("s"), F.col("user_id"))
    threads = users.select(own.alias("id"), F.concat(F.lit(" t"), "user_id").alias("title"), F.when(F.col("user_id") % 2 == 0, F.lit("high")).alias("reasoning_effort"))
    edges = users.filter("user_id >= 50").select(F.concat(F.lit("s"), F.col("user_id") - 50).alias("parent_thread_id"), own.alias("child_thread_id"))
    return index, threads, edges


@query
def session_metadata(spark, sf_dir):
    """Titles from the index, else from thread rows; parents from edges."""
    return logs.session_metadata(*_thread_tables(spark, sf_dir))


@query
def title_index_files(spark, sf_dir):
    """``session_metadata`` with the index read from files, among lines that are not entries."""
    index, threads, edges = _thread_tables(spark, sf_dir)
    entry = F.to_json(F.struct("id", "thread_name"))
    odd = F.when(F.col("line_no") % 3 == 0, F.lit('{"id": 7, "thread_name": "n"}')).when(F.col("line_no") % 3 == 1, F.lit('{"id"'))
    lines = index.select("line_no", F.explode(F.array(entry, F.coalesce(odd, F.lit("  ")))).alias("value"))
    folder = scratch_path(spark, "title-index")
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(folder)
    return logs.session_metadata(landed.read_title_index(spark, folder, "*.txt"), threads, edges)


@query
def file_report(spark, sf_dir):
    """Figures of a scan of which every third file was known before, some of them at another time."""
    files = freeze(adapters.log_file_table(spark, sf_dir).filter("modified_ms is not null"), "files")
    known = files.filter("user_id % 3 = 0").select("path", (F.col("modified_ms") + F.col("user_id") % 2).alias("modified_ms"), "size")
    lines = files.select("path", F.explode(F.sequence(F.lit(1), F.col("lines"))).alias("line_no"))
    return upserts.file_report(files, logs.changed_files(files, known), lines)


@query
def scan_report(spark, sf_dir):
    batch = adapters.log_batch(spark, sf_dir)
    earlier, later = _halves(batch)
    return upserts.batch_report(earlier.select("source_key").distinct(), later)


@query
def repair_quota_times(spark, sf_dir):
    batch = adapters.log_batch(spark, sf_dir).withColumn(
        "observed_at_ms", F.col("observed_at_ms") + 60_000
    )
    return upserts.repair_quota_times(batch).select("seq", "observed_at_ms")


def _typed(df, schema, known):
    cells = []
    for part in schema.split(", "):
        name, type_name = part.split()
        cells.append(known.get(name, F.lit(None)).cast(type_name).alias(name))
    return df.select("event_id", *cells)


@query
def external_upsert(spark, sf_dir):
    e = adapters.events(spark, sf_dir)
    batch = _typed(
        e,
        SOURCE_CCUSAGE,
        {
            "source_key": F.concat(F.lit("x"), F.col("event_id") % 311),
            "run_at_ms": F.col("observed_at_ms"),
            "total_tokens": F.col("k"),
            "amount": F.col("value"),
        },
    )
    return upserts.upsert_external(None, batch, ["event_id"]).select(
        "source_key", "run_at_ms", "total_tokens", "amount"
    )


@query
def feed_upsert(spark, sf_dir):
    k = F.col("k")
    batch = _typed(
        adapters.events(spark, sf_dir),
        SOURCE_APP_SERVER,
        {
            "source_key": F.concat(F.lit("f"), F.col("event_id") % 211),
            "kind": F.lit("account"),
            "first_seen_at_ms": F.col("observed_at_ms"),
            "last_seen_at_ms": F.col("observed_at_ms"),
            "status": F.when(k % 5 == 0, F.lit("unavailable")).otherwise(F.lit("ok")),
            "plan_type": F.when(k % 2 == 0, F.col("event_type")),
        },
    )
    return upserts.upsert_feed(None, batch, ["event_id"]).select(
        "source_key", "first_seen_at_ms", "last_seen_at_ms", "status", "plan_type"
    )


# --- account feed ----------------------------------------------------------


def _messages(spark, sf_dir):
    return account_feed.parse_messages(adapters.feed_messages(spark, sf_dir))


def _account_rows(messages):
    rows = account_feed.account_facts(messages).unionByName(account_feed.feed_errors(messages))
    return rows.select(
        "kind",
        "last_seen_at_ms",
        "account_key",
        "account_label",
        "auth_kind",
        "plan_type",
        "freshness",
        "status",
    )


@query
def account_facts(spark, sf_dir):
    return _account_rows(_messages(spark, sf_dir))


@query
def feed_quota_facts(spark, sf_dir):
    return account_feed.feed_quota_facts(_messages(spark, sf_dir)).select(
        "last_seen_at_ms",
        "account_key",
        "limit_id",
        "plan_type",
        "window_kind",
        "used_percent",
        "window_minutes",
        "resets_at_ms",
    )


@query
def feed_usage_facts(spark, sf_dir):
    return account_feed.feed_usage_facts(_messages(spark, sf_dir)).select(
        "account_key", "plan_type", "lifetime_tokens", "daily_tokens_json"
    )


def _feed(spark, sf_dir):
    facts = account_feed.feed_facts(adapters.feed_messages(spark, sf_dir))
    return upserts.upsert_feed(None, facts, account_feed.FEED_ORDER)


@query
def feed_files(spark, sf_dir):
    """Account rows and errors of polls that are read from files of enveloped messages."""
    folder = scratch_path(spark, "feed-files")
    envelope = F.to_json(F.struct("poll_id", "polled_at_ms", "msg_no", F.col("value").alias("message")))
    landing = adapters.feed_messages(spark, sf_dir).select(envelope.alias("value"))
    # Messages of a poll arrive in no order: their numbers restore it.
    landing.repartition(8, F.xxhash64("value")).select("value").write.option("compression", "none").text(folder)
    messages = account_feed.parse_messages(landed.read_polls(spark, folder, "*.txt"))
    return _account_rows(messages)


@query
def account_daily_tokens(spark, sf_dir):
    return account_feed.account_daily_tokens(_feed(spark, sf_dir))


@query
def latest_account(spark, sf_dir):
    feed = freeze(_feed(spark, sf_dir), "feed", wide=True)

    def named(scope: str, only_ok: bool) -> DataFrame:
        return account_feed.latest_account(feed, only_ok).select(
            F.lit(scope).alias("scope"), "account_key", "last_seen_at_ms"
        )

    return named("any", False).unionByName(named("ok", True))


@query
def preferred_quota(spark, sf_dir):
    """Preferred quota row of each local date."""
    quota = adapters.quota_raw(spark, sf_dir).withColumns(
        {
            "local_date": local_date(F.col("first_seen_at_ms")),
            "limit_id": F.when(
                (F.col("limit_id") == "codex") & (F.col("source") == "jsonl"), F.lit("other")
            ).otherwise(F.col("limit_id")),
        }
    )
    return report.preferred_quota(quota, F.col("last_seen_at_ms"), ["local_date"]).select(
        "local_date", "source_key", "used_percent"
    )


# --- report ----------------------------------------------------------------


@query
def selected_date(spark, sf_dir):
    return report.selected_date(_rollups(spark, sf_dir).daily, "1999-01-01")


@query
def day_view(spark, sf_dir):
    return report.day_view(_rollups(spark, sf_dir).daily).select(
        "date",
        "plan_type",
        "capacity_profile",
        "credit",
        "api_usd",
        "local_percent",
        "account_tokens",
        F.col("usage.input").alias("usage_input"),
        F.col("usage.total").alias("usage_total"),
        "quality",
    )


@query
def minute_view(spark, sf_dir):
    """Minutes as the report shows them."""
    return report.minute_view(_rollups(spark, sf_dir).minute).select(
        "minute_start_ms",
        "window_id",
        "reset_marker",
        F.col("usage.output").alias("usage_output"),
        F.col("usage.total").alias("usage_total"),
        "credit",
        "official_used_percent",
        "quality",
    )


@query
def report_models(spark, sf_dir):
    return report.report_models(_rollups(spark, sf_dir).session, ["local_date"])


@query
def report_sessions(spark, sf_dir):
    return report.report_sessions(_rollups(spark, sf_dir).session, ["local_date"]).select(
        "local_date",
        "root_session_id",
        "title",
        "primary_model",
        "started_at_ms",
        "ended_at_ms",
        "turn_count",
        F.array_join("models", ",").alias("models"),
        F.array_join("fast", ",").alias("fast"),
        "total_tokens",
        "credit",
        "api_usd",
    )


@query
def report_turns(spark, sf_dir):
    return report.report_turns(_rollups(spark, sf_dir).session).select(
        "row_key",
        "turn_id",
        "session_id",
        "root_session_id",
        "model",
        "fast",
        F.col("usage.total").alias("usage_total"),
        "credit",
    )


@query
def window_detail(spark, sf_dir):
    rollups = _rollups(spark, sf_dir)
    return report.window_detail(rollups.window, rollups.minute, rollups.session).select(
        "window_id", "total_tokens", "minute_count", "session_count", "root_count"
    )


@query
def nearest_window(spark, sf_dir):
    found = rollup.build_windows(_quota(spark, sf_dir))
    return report.nearest_window(found, 1_785_300_000_000).select("window_id", "resets_at_ms")


@query
def latest_run(spark, sf_dir):
    return report.latest_run(adapters.external_raw(spark, sf_dir)).select(
        "scope_key", "pricing_scheme", "speed", "run_at_ms", "total_tokens"
    )


@query
def validation(spark, sf_dir):
    return report.validation(adapters.external_raw(spark, sf_dir), _rollups(spark, sf_dir).daily)


@query
def fast_surcharge(spark, sf_dir):
    return report.fast_surcharge(adapters.external_raw(spark, sf_dir))


@query
def external_field_compare(spark, sf_dir):
    return report.external_field_compare(
        adapters.external_raw(spark, sf_dir), _rollups(spark, sf_dir).daily
    )


def _external_rows(results):
    return external_runs.external_usage(results).select(
        "source_key",
        "scope",
        "scope_key",
        "input_tokens",
        "cache_read_tokens",
        "total_tokens",
        "amount",
        "status",
    )


@query
def external_usage(spark, sf_dir):
    return _external_rows(adapters.external_results(spark, sf_dir))


@query
def external_files(spark, sf_dir):
    """``external_usage`` of runs that are read from files."""
    folder = scratch_path(spark, "run-files")
    runs = adapters.external_results(spark, sf_dir)
    runs.select(F.to_json(F.struct(*runs.columns))).write.text(folder)
    return _external_rows(landed.read_runs(spark, folder, "*.txt"))


@query
def run_status(spark, sf_dir):
    return external_runs.run_status(adapters.external_results(spark, sf_dir))


@query
def minute_cumulative(spark, sf_dir):
    return report.minute_cumulative(_rollups(spark, sf_dir).minute)


@query
def capacity_candidates(spark, sf_dir):
    return report.capacity_candidates(freeze(_rollups(spark, sf_dir).minute, "minutes"))


@query
def candidate_spread(spark, sf_dir):
    return report.candidate_spread(freeze(_rollups(spark, sf_dir).minute, "minutes"))


@query
def unobserved_percent(spark, sf_dir):
    return report.unobserved_percent(_rollups(spark, sf_dir).window)


@query
def audit_counts(spark, sf_dir):
    rollups = _rollups(spark, sf_dir)
    usage = adapters.usage_raw(spark, sf_dir).withColumn("kind", F.lit("usage"))
    return report.audit(
        rollups.daily, rollups.session, rollups.window, usage, adapters.external_raw(spark, sf_dir)
    )


@query
def sync_counts(spark, sf_dir):
    usage = adapters.usage_raw(spark, sf_dir).withColumn("kind", F.lit("usage"))
    days = usage.select(local_date(F.col("observed_at_ms")).alias("local_date")).distinct()
    return report.sync_counts(usage, days)


def _current(spark, sf_dir, feed, now_ms, log_rows):
    rollups = _rollups(spark, sf_dir)
    return report.current(
        feed,
        log_rows,
        freeze(rollups.minute, "minutes"),
        freeze(rollups.window, "window-table"),
        rollups.inputs.capacities,
        now_ms,
    ).withColumn("quality_flags", F.concat_ws(",", "quality_flags"))


def _log_quota(spark, sf_dir):
    return (
        adapters.quota_raw(spark, sf_dir)
        .filter("source = 'jsonl'")
        .withColumns({"kind": F.lit("quota"), "observed_at_ms": F.col("first_seen_at_ms")})
    )


@query
def current_state(spark, sf_dir):
    """Current state a minute after the last message of the feed."""
    feed = freeze(_feed(spark, sf_dir), "feed", wide=True)
    now_ms = feed.agg(F.max("last_seen_at_ms")).first()[0] + 60_000
    return _current(spark, sf_dir, feed, now_ms, _log_quota(spark, sf_dir))


@query
def current_state_logs(spark, sf_dir):
    """Current state without a feed, so without an account row, a minute after the last log quota."""
    log_rows = freeze(_log_quota(spark, sf_dir), "log-quota")
    now_ms = log_rows.agg(F.max("last_seen_at_ms")).first()[0] + 60_000
    return _current(spark, sf_dir, small_table(spark, [], SOURCE_APP_SERVER), now_ms, log_rows)


@query
def current_state_stale(spark, sf_dir):
    """Current state a day after the last message: every source is too old."""
    feed = freeze(_feed(spark, sf_dir), "feed", wide=True)
    now_ms = feed.agg(F.max("last_seen_at_ms")).first()[0] + 86_400_000
    return _current(spark, sf_dir, feed, now_ms, _log_quota(spark, sf_dir))


@query
def report_document(spark, sf_dir):
    """Items and tokens of every section of the report, counted in its document."""
    tokens = F.get_json_object("item", "$.usage.total").cast("bigint")
    counted = []
    with scratch(spark):
        with scratch(spark):
            feed = keep(_feed(spark, sf_dir), "feed", wide=True)
        now_ms = feed.agg(F.max("last_seen_at_ms")).first()[0] + 60_000
        with scratch(spark):  # what the tables are made from goes before the report is
            rollups = _rollups(spark, sf_dir)
            tables = {name: keep(table, name) for name, table in rollups.tables().items()}
        sections = report.report_sections(
            tables,
            _log_quota(spark, sf_dir),
            feed,
            freeze(adapters.external_raw(spark, sf_dir), "external"),
            rollups.inputs.capacities,
            *_catalogs(spark),
            now_ms,
        )
        # One after the other, so that only one section's shuffles are on disk.
        for name, section in sections.items():
            items = report.report_document({name: section}).groupBy("section")
            counted.append(keep(items.agg(F.count(F.lit(1)).alias("items"), F.sum(tokens).alias("tokens")), f"section-{name}"))
    return reduce(DataFrame.unionByName, counted)


# --- capacity and scalars --------------------------------------------------


def _mixed_capacities(spark):
    rows = [
        ("usd20", None, None, 3200.0, 0, None),
        ("usd100", None, None, 16000.0, 0, None),
        ("usd200", None, None, 64000.0, 0, None),
        ("usd20", None, "pro", 50000.0, 1_785_000_000_000, None),
        ("usd100", "s7", None, 17000.0, 1_785_500_000_000, 1_786_000_000_000),
    ]
    names = [
        "profile_code",
        "account_key",
        "plan_type",
        "weekly_credit",
        "effective_from_ms",
        "effective_to_ms",
    ]
    return small_table(spark, [dict(zip(names, row)) for row in rows], CAPACITY_SCHEMA)


def _asked_capacity(spark, sf_dir):
    plan = F.when(
        (F.col("plan_type") == "team") & (F.col("input_tokens") % 2 == 0), F.lit("business")
    ).otherwise(F.col("plan_type"))
    number = F.substring("session_id", 2, 20).cast("bigint")
    return (
        adapters.usage_raw(spark, sf_dir).select(
            "source_key",
            F.concat(F.lit("s"), number % 10).alias("account_key"),
            plan.alias("plan_type"),
            F.col("observed_at_ms").alias("at_ms"),
        )
    )


def _capacity_arguments():
    return F.col("account_key"), F.col("plan_type"), F.col("at_ms")


def _chosen(spark, sf_dir, **how):
    return capacity.with_capacity(
        _asked_capacity(spark, sf_dir), _mixed_capacities(spark), *_capacity_arguments(), **how
    ).select(
        "source_key",
        F.col("capacity.profile_code").alias("capacity_profile"),
        F.col("capacity.weekly_credit").alias("weekly_credit"),
    )


@query
def capacity_for(spark, sf_dir):
    return _chosen(spark, sf_dir)


@query
def capacity_for_join(spark, sf_dir):
    """As ``capacity_for``, which is this join at every size."""
    return _chosen(spark, sf_dir)


@query
def capacity_for_plan(spark, sf_dir):
    return _chosen(spark, sf_dir, profile=F.when(F.col("account_key") != "s3", F.lit("usd100")))


@query
def current_capacity(spark, sf_dir):
    return _chosen(spark, sf_dir, rule="current").select("source_key", "weekly_credit")


@query
def capacity_seeding(spark, sf_dir):
    """Dated capacities from events are promoted over seeds; one value is set by hand."""
    kind = F.col("event_type")
    dated = (
        adapters.events(spark, sf_dir)
        .filter(kind.isin("click", "view"))
        .groupBy(
            F.when(kind == "click", F.lit("usd20")).otherwise(F.lit("usd100")).alias("profile_code")
        )
        .agg(
            F.max("user_id").cast("double").alias("weekly_credit"),
            F.max("event_id").alias("effective_from_ms"),
        )
        .select(
            "profile_code",
            F.lit("old").alias("account_key"),
            F.lit(None).cast("string").alias("plan_type"),
            "weekly_credit",
            "effective_from_ms",
            F.lit(None).cast("bigint").alias("effective_to_ms"),
            F.col("effective_from_ms").alias("confirmed_at_ms"),
        )
    )
    seeded = ensure_capacities(dated)
    return set_capacity(seeded, "usd200", 55_000.0, 77).select(
        "profile_code", "account_key", "weekly_credit", "effective_from_ms", "confirmed_at_ms"
    )


@query
def scalar_functions(spark, sf_dir):
    at, total, inp = F.col("observed_at_ms"), F.col("total_tokens"), F.col("input_tokens")
    plan = accounts.effective_plan(F.col("plan_type"), F.col("provider"))
    date = local_date(at)
    names = F.array(*[F.lit(n) for n in ("Default", "PRIORITY", "flex", "", "x")])
    return adapters.usage_raw(spark, sf_dir).select(
        "source_key",
        timeline.minute_start(at).alias("minute_start_ms"),
        date.alias("local_date"),
        timeline.day_start_ms(date).alias("day_start_ms"),
        timeline.day_end_ms(date).alias("day_end_ms"),
        plan.alias("effective_plan"),
        accounts.usage_context(plan).alias("context"),
        accounts.default_profile(F.col("plan_type")).alias("profile"),
        accounts.dedupe_model(F.col("model")).alias("dedupe_model"),
        accounts.normalize_tier(F.element_at(names, (inp % 5 + 1).cast("int"))).alias("tier"),
        timeline.number_epoch_ms(
            F.when(total < 100_000, total).otherwise(total + 100_000_000_000)
        ).alias("epoch_ms"),
        accounts.money(total).alias("amount"),
        accounts.dollars_per_token(inp).alias("per_token"),
        accounts.remaining_percent((inp % 150).cast("double")).alias("remaining"),
        timeline.is_fresh(at, F.lit(1_786_000_000_000)).alias("fresh"),
        accounts.is_subscription_plan(F.col("plan_type")).alias("is_subscription"),
    )


@query
def quota_union(spark, sf_dir):
    """Log and feed quota rows as one list, with what the account supplies."""
    raw = adapters.quota_raw(spark, sf_dir).withColumn("kind", F.lit("quota"))
    in_feed = F.col("source") == "app_server"
    log_rows = raw.filter(~in_feed).withColumn("observed_at_ms", F.col("first_seen_at_ms"))
    feed_rows = raw.filter(in_feed).withColumns(
        {"account_key": F.lit(None).cast("string"), "window_kind": F.lit(None).cast("string")}
    )
    return windows.quota_observations(log_rows, feed_rows, "acct", "pro").drop("window_minutes")
