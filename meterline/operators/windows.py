"""Quota observations, reset windows and the as-of assignment to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import (
    CANONICAL_LIMIT,
    INFERRED_DROP_PERCENT,
    INFERRED_MAX_NEW_PERCENT,
    INFERRED_MIN_GAP_MS,
    INFERRED_MIN_PREVIOUS_PERCENT,
    RESET_DROP_PERCENT,
    RESET_JITTER_MS,
)
from ..functions.ordered import Running, ordered_scan, range_chunks
from ..functions.storage import freeze
from ..functions.timeline import minute_start

_SEEN = ["first_seen_at_ms", "last_seen_at_ms", "priority", "source_key"]


def quota_observations(
    logs: DataFrame, feed: DataFrame, account_key: str | None, account_plan: str | None
) -> DataFrame:
    """Union of log and feed quota rows; the feed outranks the log."""
    log_rows = logs.filter("kind = 'quota'").select(
        "source_key",
        F.col("observed_at_ms").alias("first_seen_at_ms"),
        F.coalesce("last_seen_at_ms", "observed_at_ms").alias("last_seen_at_ms"),
        F.lit(account_key).cast("string").alias("account_key"),
        "limit_id",
        F.coalesce("window_kind", F.lit("primary")).alias("window_kind"),
        "used_percent",
        "window_minutes",
        "resets_at_ms",
        "plan_type",
        F.lit("jsonl").alias("source"),
        F.lit(1).alias("priority"),
    )
    feed_rows = feed.filter("kind = 'quota'").select(
        "source_key",
        "first_seen_at_ms",
        "last_seen_at_ms",
        F.coalesce("account_key", F.lit(account_key).cast("string")).alias("account_key"),
        "limit_id",
        F.coalesce("window_kind", F.lit("primary")).alias("window_kind"),
        "used_percent",
        "window_minutes",
        "resets_at_ms",
        F.coalesce("plan_type", F.lit(account_plan).cast("string")).alias("plan_type"),
        F.lit("app_server").alias("source"),
        F.lit(2).alias("priority"),
    )
    return log_rows.unionByName(feed_rows)


def canonical_limit(quota: DataFrame) -> DataFrame:
    """Where an account has the canonical primary limit, drop its other primary limits."""
    canonical = F.coalesce(F.col("limit_id") == CANONICAL_LIMIT, F.lit(False))
    primary = F.col("window_kind") == "primary"
    accounts = (
        quota.filter(primary & canonical)
        .select(F.col("account_key").alias("canonical_account"))
        .distinct()
    )
    others = quota.filter(primary & ~canonical)
    kept = others.join(
        accounts, others["account_key"].eqNullSafe(accounts["canonical_account"]), "left_anti"
    )
    return quota.filter(~primary | canonical).unionByName(kept)


def group_key() -> Column:
    return F.concat_ws(
        ":",
        F.coalesce("account_key", F.lit("unknown")),
        F.coalesce("limit_id", F.lit("unknown")),
        F.col("window_kind"),
    )


def _reset_blocks(quota: DataFrame) -> DataFrame:
    """Runs of observations between the rows at which a new window could start.

    Whether a row starts a window depends on the largest percent since the
    last start, which is not known yet; everything else in the two rules
    depends on earlier rows only.  A row that meets that part and lies below
    the largest percent ever seen in its group is a candidate.  An explicit
    candidate moves the group's latest reset by five minutes or more and an
    inferred one follows a gap of half an hour, so their number is bounded by
    the time span of a group and not by its rows.
    """
    facts = quota.groupBy(*[c for c in quota.columns if c != "source_key"]).agg(
        F.min("source_key").alias("source_key")
    )
    chunks = range_chunks(facts.withColumn("quota_group", group_key()), ["quota_group"], _SEEN,
                          "quota")
    earlier = ordered_scan(
        chunks,
        ["quota_group"],
        _SEEN,
        [
            Running("_reset", "max", F.col("resets_at_ms"), before=True),
            Running("_peak", "max", F.col("used_percent"), before=True),
            Running("_source", "last", F.col("source"), before=True),
            Running("_seen", "last", F.col("first_seen_at_ms"), before=True),
        ],
    )
    new = F.col("used_percent")
    both_resets = F.col("_reset").isNotNull() & F.col("resets_at_ms").isNotNull()
    explicit = (
        both_resets
        & (F.col("resets_at_ms") - F.col("_reset") > RESET_JITTER_MS)
        & (new + RESET_DROP_PERCENT < F.col("_peak"))
    )
    inferred = (
        ~both_resets
        & (F.col("_source") == "jsonl")
        & (F.col("source") == "jsonl")
        & (F.col("first_seen_at_ms") - F.col("_seen") >= INFERRED_MIN_GAP_MS)
        & (new <= INFERRED_MAX_NEW_PERCENT)
        & (F.col("_peak") >= INFERRED_MIN_PREVIOUS_PERCENT)
        & (F.col("_peak") - new >= INFERRED_DROP_PERCENT)
    )
    rule = (
        F.when(F.col("_seen").isNull(), F.lit("first"))
        .when(F.coalesce(explicit, F.lit(False)), F.lit("explicit"))
        .when(F.coalesce(inferred, F.lit(False)), F.lit("inferred"))
    )
    marked = earlier.withColumn("rule", rule)
    numbered = ordered_scan(
        marked,
        ["quota_group"],
        _SEEN,
        [Running("block_no", "sum", F.col("rule").isNotNull().cast("bigint"))],
    )
    order = F.struct(*_SEEN)

    def first_known(name: str) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), order))

    head = F.struct("first_seen_at_ms", "used_percent", "limit_id", "window_kind")
    return numbered.groupBy("quota_group", "block_no").agg(
        F.max("rule").alias("rule"),
        F.min_by(head, order).alias("head"),
        F.max("used_percent").alias("peak"),
        F.max("resets_at_ms").alias("reset"),
        F.max_by("window_minutes", F.when(F.col("window_minutes").isNotNull(), order)).alias(
            "minutes"
        ),
        first_known("account_key").alias("account_key"),
        first_known("plan_type").alias("plan_type"),
    )


_WALK = "struct<peak:double,starts:array<struct<block_no:bigint,inferred:boolean>>>"


def _window_starts(blocks: DataFrame) -> DataFrame:
    """(quota_group, block_no, inferred) of the blocks that start a window.

    A fold over a group's candidate blocks in order; the state is the largest percent since
    the last start.  The blocks of a group are bounded by its time span.
    """
    candidate = F.struct("block_no", "rule", F.col("head.used_percent").alias("percent"), "peak")
    lists = blocks.groupBy("quota_group").agg(F.array_sort(F.collect_list(candidate)).alias("blocks"))
    nothing = F.struct(
        F.lit(None).alias("peak"), F.array().alias("starts")
    ).cast(_WALK)

    def step(state: Column, block: Column) -> Column:
        fell = (block["rule"] == "explicit") & (block["percent"] + RESET_DROP_PERCENT < state["peak"])
        vanished = (
            (block["rule"] == "inferred")
            & (state["peak"] >= INFERRED_MIN_PREVIOUS_PERCENT)
            & (state["peak"] - block["percent"] >= INFERRED_DROP_PERCENT)
        )
        first = F.size(state["starts"]) == 0
        inferred = ~first & F.coalesce(vanished, F.lit(False))
        starts = first | F.coalesce(fell, F.lit(False)) | inferred
        start = F.array(F.struct(block["block_no"].alias("block_no"), inferred.alias("inferred")))
        return F.struct(
            F.when(starts, block["peak"]).otherwise(F.greatest(state["peak"], block["peak"])).alias("peak"),
            F.when(starts, F.concat(state["starts"], start)).otherwise(state["starts"]).alias("starts"),
        ).cast(_WALK)

    found = F.aggregate("blocks", nothing, step, lambda state: state["starts"])
    return lists.select("quota_group", F.explode(found).alias("start")).select("quota_group", "start.*")


def reset_windows(quota: DataFrame) -> DataFrame:
    """Cut every (account, limit, kind) into windows at observed or inferred resets.

    Result: window_id, account_key, limit_id, window_kind, window_start_ms,
    resets_at_ms, window_minutes, plan_type, inferred_after_gap, ordinal and
    quota_group.  Resets may still reach into the next window.
    """
    blocks = freeze(_reset_blocks(quota), "reset-blocks")
    started = blocks.join(_window_starts(blocks), ["quota_group", "block_no"], "left")
    upto = Window.partitionBy("quota_group").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    joined = started.withColumns(
        {
            "ordinal": F.count("inferred").over(upto) - 1,
            "inferred": F.coalesce("inferred", F.lit(False)),
        }
    )

    def first_known(name: str) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("block_no")))

    segments = joined.groupBy("quota_group", "ordinal").agg(
        F.min_by("head", "block_no").alias("head"),
        first_known("account_key").alias("account_key"),
        first_known("plan_type").alias("plan_type"),
        F.max("reset").alias("reset"),
        F.max_by("minutes", F.when(F.col("minutes").isNotNull(), F.col("block_no"))).alias(
            "minutes"
        ),
        F.max("inferred").alias("inferred"),
    )
    following = Window.partitionBy("quota_group").orderBy("ordinal")
    start = F.col("head.first_seen_at_ms")
    next_start = F.lead(start).over(following)
    closed = F.when(start < next_start, next_start).otherwise(F.col("reset"))
    return segments.select(
        F.concat(F.lit("window:"), "quota_group", F.lit(":"), "ordinal").alias("window_id"),
        "account_key",
        F.col("head.limit_id").alias("limit_id"),
        F.col("head.window_kind").alias("window_kind"),
        start.alias("window_start_ms"),
        closed.alias("resets_at_ms"),
        F.col("minutes").alias("window_minutes"),
        "plan_type",
        (F.col("inferred") | F.coalesce(F.lead("inferred").over(following), F.lit(False))).alias(
            "inferred_after_gap"
        ),
        "ordinal",
        "quota_group",
    )


def disjoint_windows(windows: DataFrame) -> DataFrame:
    """End a window no later than the next one of its group starts."""
    following = Window.partitionBy("quota_group").orderBy("window_start_ms", "ordinal")
    next_start = F.lead("window_start_ms").over(following)
    reset = F.col("resets_at_ms")
    return windows.withColumn(
        "resets_at_ms", F.when(reset > next_start, next_start).otherwise(reset)
    )


#: The bin of each line's earliest window, before every minute.
_BEFORE_ALL = -(2**62)


def assign_asof(
    facts: DataFrame, at: str, windows: DataFrame, keys: list[str], moments: DataFrame | None = None
) -> DataFrame:
    """Add ``window_id`` of the latest window that starts at or before ``at``.

    Facts and windows with equal ``keys`` (nulls are equal) lie on one line.  A
    fact before every window of its line takes the earliest one; a line without
    windows and a null ``at`` give null.  Of windows with one start the last in
    order counts.

    The minutes that facts fall in and those that windows start in are scanned
    in order, which tells each minute its window on entry; the starts inside a
    minute stay beside it, 60,000 at most.  A fact then meets the one row of its
    minute, so nothing is laid out over time and no pair is formed that does not
    match, however many windows a line has and however long the last is open.

    ``moments`` holds ``keys`` and ``at`` of all facts, and perhaps of more rows;
    it spares evaluating ``facts`` for its minutes.
    """
    def line() -> Column:
        return F.to_json(F.struct(*keys)) if keys else F.lit("")

    start, tie = F.col("window_start_ms"), ["quota_group", "ordinal"]
    starts = windows.groupBy(line().alias("_line"), start.alias("_from_ms")).agg(
        F.max_by("window_id", F.struct(*tie)).alias("_id")
    )
    inside = starts.groupBy("_line", minute_start(F.col("_from_ms")).alias("_bin")).agg(
        F.sort_array(F.collect_list(F.struct("_from_ms", "_id"))).alias("_inside")
    )
    heads = windows.groupBy(line().alias("_line")).agg(
        F.min_by("window_id", F.struct(start, *tie)).alias("_last")
    )
    asked = (facts if moments is None else moments).filter(F.col(at).isNotNull()).select(
        line().alias("_line"), minute_start(F.col(at)).alias("_bin"), F.lit(None).cast("string").alias("_last")
    ).distinct()
    points = (
        inside.select("_line", "_bin", F.element_at("_inside", -1).getField("_id").alias("_last"))
        .unionByName(heads.select("_line", F.lit(_BEFORE_ALL).alias("_bin"), "_last"))
        .unionByName(asked)
        .groupBy("_line", "_bin")
        .agg(F.max("_last").alias("_last"))
    )
    entered = ordered_scan(
        range_chunks(points, ["_line"], ["_bin"], "window-minutes"),
        ["_line"],
        ["_bin"],
        [Running("_entry", "last", F.col("_last"), before=True)],
    ).select("_line", "_bin", "_entry")
    minutes = freeze(entered.join(inside, ["_line", "_bin"], "left"), "window-entries")
    begun = F.filter("_inside", lambda x: x["_from_ms"] <= F.col(at))
    return (
        facts.withColumns({"_line": line(), "_bin": minute_start(F.col(at))})
        .join(minutes, ["_line", "_bin"], "left")
        .select(
            *facts.columns,
            F.coalesce(F.try_element_at(begun, F.lit(-1)).getField("_id"), "_entry").alias("window_id"),
        )
    )


def usage_window(usage: DataFrame, windows: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """Window of each usage event: primary windows only, or all if there is no primary."""
    primary = windows.filter("window_kind = 'primary'")
    candidates = windows if primary.isEmpty() else primary
    return assign_asof(usage, "observed_at_ms", candidates, [], moments)


def quota_window(quota: DataFrame, windows: DataFrame) -> DataFrame:
    """Window of each quota observation within its kind, limit and account."""
    return assign_asof(
        quota, "first_seen_at_ms", windows, ["window_kind", "limit_id", "account_key"]
    )


def official_points(quota_windowed: DataFrame) -> DataFrame:
    """Minute and window buckets of quota rows with the winning official percent.

    The highest priority wins, and the latest of equal priority.
    """
    order = F.struct("priority", "first_seen_at_ms", "last_seen_at_ms", "source_key")
    seen = F.struct("first_seen_at_ms", "last_seen_at_ms", "priority", "source_key")

    def first_known(name: str) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), seen))

    point = F.max_by(
        F.struct("used_percent", "source"), F.when(F.col("used_percent").isNotNull(), order)
    )
    return (
        quota_windowed.groupBy(
            minute_start(F.col("first_seen_at_ms")).alias("minute_start_ms"), "window_id"
        )
        .agg(
            point.alias("point"),
            first_known("account_key").alias("quota_account_key"),
            first_known("plan_type").alias("quota_plan_type"),
        )
        .select(
            "minute_start_ms",
            "window_id",
            F.col("point.used_percent").alias("official_used_percent"),
            F.col("point.source").alias("official_source"),
            "quota_account_key",
            "quota_plan_type",
        )
    )


def official_delta(points: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """First and last percent and the sum of rises, per ``keys``.

    Rises are taken between neighbours inside ``within`` (``keys`` if not
    given).  ``points`` holds minute buckets, so a group is bounded by the
    minutes it spans.
    """
    inside = Window.partitionBy(*(within or keys)).orderBy("minute_start_ms")
    rise = F.col("official_used_percent") - F.lag("official_used_percent").over(inside)
    order = F.struct("minute_start_ms", "window_id")
    return (
        points.withColumn("_rise", rise)
        .groupBy(*keys)
        .agg(
            F.min_by("official_used_percent", order).alias("official_percent_start"),
            F.max_by("official_used_percent", order).alias("official_percent_end"),
            F.sum(F.when(F.col("_rise") >= 0, F.col("_rise"))).alias("_delta"),
        )
        .withColumn("official_percent_delta", F.when(F.col("_delta") > 0, F.col("_delta")))
        .drop("_delta")
    )
