"""Assign usage events to turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Running, ordered_scan, range_chunks
from ..functions.storage import freeze


def _power_bins(start: Column, end: Column) -> Column:
    """Aligned power-of-two bins that exactly tile ``[start, end]``.

    At most two per level, so a turn of any length becomes a short list.
    """
    def level_bins(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        low = F.call_function("shiftright", start + size - 1, level)
        high = F.call_function("shiftright", end + 1, level)
        low_odd = F.pmod(low, F.lit(2)) == 1
        high_odd = F.pmod(high, F.lit(2)) == 1
        after_low = F.when(low_odd, low + 1).otherwise(low)
        return F.array(
            F.when((low < high) & low_odd, F.struct(level.alias("level"), low.alias("bin"))),
            F.when(
                (low < high) & high_odd & (after_low < high),
                F.struct(level.alias("level"), (high - 1).alias("bin")),
            ),
        )

    levels = F.sequence(F.lit(0), F.length(F.bin(end - start + 1)))
    return F.filter(F.flatten(F.transform(levels, level_bins)), lambda b: b.isNotNull())


def _covering(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """Latest-starting finished turn that contains each time.

    For facts known to lie in one.  Both sides meet on bins, where a shared
    bin means containment: no pair of a fact and a turn that does not contain
    it is ever formed.  A fact probes only the levels that its own session's turns use.
    """
    sessions = facts.select("_session").distinct()
    finished = turns.join(sessions, "_session", "left_semi").filter(
        "ended_at_ms >= started_at_ms"
    )
    bins = freeze(
        finished.select(
            "_session",
            F.struct("started_at_ms", "turn_id", "ended_at_ms").alias("turn"),
            F.explode(_power_bins(F.col("started_at_ms"), F.col("ended_at_ms"))).alias("b"),
        )
        .groupBy("_session", F.col("b.level").alias("level"), F.col("b.bin").alias("bin"))
        .agg(F.max("turn").alias("turn")),
        "turn-bins",
    )
    levels = bins.groupBy("_session").agg(F.collect_set("level").alias("levels"))
    probes = facts.select("source_key", "_session", "_at").join(levels, "_session").select(
        "source_key", "_session", "_at", F.explode("levels").alias("level")
    ).withColumn("bin", F.call_function("shiftright", F.col("_at"), F.col("level")))
    return (
        probes.join(bins, ["_session", "level", "bin"])
        .groupBy("source_key")
        .agg(F.max("turn").alias("_found"))
    )


def assign_turn(usage: DataFrame, turns: DataFrame) -> DataFrame:
    """Add ``turn_started_ms`` and ``turn_ended_ms`` and fill ``turn_id``.

    First the turn of the same session and id; else the latest-starting turn
    that contains the event; else the latest one that started before it.  An
    event keeps its own turn id when it has one.
    """
    session = F.coalesce("session_id", F.lit("unknown-session"))
    keyed = usage.withColumn("_session", session)
    known = freeze(turns.filter("session_id is not null and turn_id is not null"), "turns-known")
    exact = known.groupBy(F.col("session_id").alias("_session"), "turn_id").agg(
        F.min(F.struct("started_at_ms", "ended_at_ms")).alias("_turn")
    )
    with_id = keyed.filter("turn_id is not null").join(exact, ["_session", "turn_id"], "left")
    columns = usage.columns

    def result(df: DataFrame, turn: str, turn_id: Column) -> DataFrame:
        return df.select(
            *[c for c in columns if c != "turn_id"],
            turn_id.alias("turn_id"),
            F.col(f"{turn}.started_at_ms").alias("turn_started_ms"),
            F.col(f"{turn}.ended_at_ms").alias("turn_ended_ms"),
        )

    matched = result(with_id.filter("_turn is not null"), "_turn", F.col("turn_id"))
    rest = keyed.filter("turn_id is null").unionByName(
        with_id.filter("_turn is null").select(*keyed.columns)
    )
    started = known.filter("started_at_ms is not null").select(
        F.col("session_id").alias("_session"), "turn_id", "started_at_ms", "ended_at_ms"
    )
    turn = F.struct("started_at_ms", "turn_id", "ended_at_ms")
    line = (
        started.select(
            "_session",
            F.col("started_at_ms").alias("_at"),
            F.lit(0).alias("_kind"),
            F.col("turn_id").alias("_tie"),
            turn.alias("_turn_here"),
        )
        .unionByName(
            rest.select(
                "_session",
                F.col("observed_at_ms").alias("_at"),
                F.lit(1).alias("_kind"),
                F.col("source_key").alias("_tie"),
                F.struct(*columns).alias("_usage"),
            ),
            allowMissingColumns=True,
        )
    )
    order = ["_at", "_kind", "_tie"]
    scanned = ordered_scan(
        range_chunks(line, ["_session"], order, "turn-line"),
        ["_session"],
        order,
        [
            Running("_latest", "last", F.col("_turn_here")),
            Running(
                "_open",
                "last",
                F.when(F.col("_turn_here.ended_at_ms").isNull(), F.col("_turn_here")),
            ),
            Running("_furthest", "max", F.col("_turn_here.ended_at_ms")),
        ],
    )
    looked_up = freeze(
        scanned.filter("_kind = 1").select(
            "_session", "_at", "_usage.*", "_latest", "_open", "_furthest"
        ),
        "turn-lookup",
    )
    # The latest turn has ended, but an earlier and longer one may not have.
    searching = (F.col("_at") > F.col("_latest.ended_at_ms")) & (F.col("_furthest") >= F.col("_at"))
    searched = looked_up.withColumn("_search", F.coalesce(searching, F.lit(False)))
    ended = F.col("_at") > F.col("_latest.ended_at_ms")
    to_search = searched.filter("_search")
    if to_search.isEmpty():
        covering = F.col("_open")
    else:
        searched = searched.join(_covering(to_search, started), "source_key", "left")
        covering = F.greatest("_open", "_found")
    settled = searched.withColumn(
        "_chosen", F.when(ended, F.coalesce(covering, F.col("_latest"))).otherwise(F.col("_latest"))
    )
    return matched.unionByName(
        result(settled, "_chosen", F.coalesce("turn_id", F.col("_chosen.turn_id")))
    )
