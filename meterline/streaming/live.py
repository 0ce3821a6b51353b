"""Streaming views of usage and quota facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TOKEN_COLUMNS


def with_event_time(facts: DataFrame) -> DataFrame:
    return facts.withColumn("event_time", F.timestamp_millis("observed_at_ms"))


def dedupe_stream(facts: DataFrame, delay: str) -> DataFrame:
    """Each ``source_key`` once within the watermark.

    The delay bounds the state and is an addition for streams only; it must
    not be shorter than the range that is read again.
    """
    return (
        with_event_time(facts)
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["source_key"])
    )


def minute_totals(facts: DataFrame, delay: str) -> DataFrame:
    """Token totals of tumbling minutes.

    Rows later than ``delay`` are dropped, so it must cover the range that is read again.
    """
    minute = F.window("event_time", "1 minute")
    return (
        with_event_time(facts)
        .withWatermark("event_time", delay)
        .groupBy(minute.alias("w"))
        .agg(*[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.count(F.lit(1)).alias("events"))
        .select(F.unix_millis("w.start").alias("minute_start_ms"), *TOKEN_COLUMNS, "events")
    )
