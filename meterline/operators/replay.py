"""Drop usage that a forked log copied from its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import REPLAY_BURST_GAP_MS
from ..functions.ordered import CHUNK, Running, ordered_scan
from ..functions.storage import freeze
from ..functions.tokens import TOKEN_COLUMNS

_LINE = ["block", "line_no"]


def number_events(usage: DataFrame) -> DataFrame:
    """Position of each usage event in its file, and the time of the one before."""
    return ordered_scan(
        usage.withColumn(CHUNK, F.col("block")),
        ["path"],
        _LINE,
        [
            Running("idx", "sum", F.lit(1).cast("bigint")),
            Running("previous_ms", "last", F.col("observed_at_ms"), before=True),
            Running("latest_ms", "max", F.col("observed_at_ms"), before=True),
        ],
    )


def _parent_files(headers: DataFrame) -> DataFrame:
    """Files with a parent, with the parent's file: the first path of its session."""
    files = headers.filter("session_id is not null").groupBy(
        F.col("session_id").alias("parent_session_id")
    ).agg(F.min("path").alias("parent_path"))
    return (
        headers.filter("parent_session_id is not null")
        .join(files, "parent_session_id", "left")
        .select("path", "parent_path", "forked_at_ms")
    )


def _first_miss(children: DataFrame, events: DataFrame) -> DataFrame:
    """First position of each child at which it differs from its parent's events.

    The parent's list is cut at the fork time.  Where the parent's times only
    rise, the cut keeps positions, so child and parent meet on (file,
    position): one row against one.
    """
    tokens = F.struct(*TOKEN_COLUMNS)
    disorder = (
        events.groupBy(F.col("path").alias("parent_path"))
        .agg(F.max(F.coalesce(F.col("observed_at_ms") < F.col("latest_ms"), F.lit(False))).alias("mixed"))
    )
    marked = freeze(
        children.join(disorder, "parent_path", "left").withColumn(
            "mixed", F.coalesce("mixed", F.lit(False))
        ),
        "replay-files",
    )
    child_events = events.select("path", "idx", tokens.alias("tokens"))
    parents = events.select(
        F.col("path").alias("parent_path"),
        "idx",
        tokens.alias("parent_tokens"),
        F.col("observed_at_ms").alias("parent_ms"),
        *_LINE,
    )

    def misses(pairs: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
        cut = F.col("forked_at_ms").isNull() | (F.col("parent_ms") <= F.col("forked_at_ms"))
        hit = F.coalesce(cut & F.col("tokens").eqNullSafe(F.col("parent_tokens")), F.lit(False))
        return (
            pairs.join(child_events, "path")
            .join(expected, keys, "left")
            .groupBy("path")
            .agg(F.min(F.when(~hit, F.col("idx"))).alias("first_miss"))
        )

    ordered = misses(
        marked.filter("not mixed"), parents.drop(*_LINE), ["parent_path", "idx"]
    )
    mixed = marked.filter("mixed")
    if mixed.isEmpty():
        return ordered
    # A parent whose times go back: number its events again after each cut.
    cut_events = (
        mixed.join(parents.drop("idx"), "parent_path")
        .filter("forked_at_ms is null or parent_ms <= forked_at_ms")
        .withColumn(CHUNK, F.col("block"))
        .select("path", *_LINE, CHUNK, "parent_tokens", "parent_ms")
    )
    renumbered = ordered_scan(
        cut_events, ["path"], _LINE, [Running("idx", "sum", F.lit(1).cast("bigint"))]
    ).select("path", "idx", "parent_tokens", "parent_ms")
    return ordered.unionByName(misses(mixed, renumbered, ["path", "idx"]))


def leading_burst(events: DataFrame) -> DataFrame:
    """Length of the leading run with gaps of at most a second; null below two."""
    gap = F.col("observed_at_ms") - F.col("previous_ms") > REPLAY_BURST_GAP_MS
    length = F.coalesce(F.min(F.when(gap, F.col("idx"))) - 1, F.max("idx"))
    return (
        events.groupBy("path")
        .agg(length.alias("burst"))
        .withColumn("burst", F.when(F.col("burst") >= 2, F.col("burst")))
    )


def replayed_usage(usage: DataFrame, headers: DataFrame) -> DataFrame:
    """Usage rows to drop: the longest prefix equal to the parent's, else the burst.

    ``usage`` has path, block, line_no, observed_at_ms and the token columns.
    """
    events = freeze(number_events(usage), "replay-events")
    children = _parent_files(headers)
    dropped = (
        events.join(children.select("path"), "path", "left_semi")
        .join(_first_miss(children, events), "path", "left")
        .join(leading_burst(events), "path", "left")
    )
    prefix = F.col("first_miss").isNull() | (F.col("idx") < F.col("first_miss"))
    burst = (F.col("first_miss") == 1) & (F.col("idx") <= F.col("burst"))
    return dropped.filter(prefix | F.coalesce(burst, F.lit(False))).select(
        "path", *_LINE, "observed_at_ms"
    )


def strip_replay(facts: DataFrame, headers: DataFrame) -> DataFrame:
    """Facts without replayed usage and without the quota rows of the same instants."""
    usage = facts.filter("kind = 'usage'")
    dropped = freeze(replayed_usage(usage, headers), "replayed")
    times = dropped.select("path", "observed_at_ms").distinct()
    return (
        facts.filter("kind not in ('usage', 'quota')")
        .unionByName(usage.join(dropped.select("path", *_LINE), ["path", *_LINE], "left_anti")
                     .select(*facts.columns))
        .unionByName(
            facts.filter("kind = 'quota'")
            .join(times, ["path", "observed_at_ms"], "left_anti")
            .select(*facts.columns)
        )
    )
