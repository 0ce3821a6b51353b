"""Integer time arithmetic at a fixed +08:00 offset, independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import DAY_MS, FRESH_MAX_AGE_MS, LOCAL_OFFSET_MS, MINUTE_MS, SECONDS_CUTOFF


def _div(value: Column, by: int) -> Column:
    """Floor division for 64-bit integers of either sign."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def minute_start(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(MINUTE_MS))


def local_day(ms: Column) -> Column:
    """Days since 1970-01-01 on the +08:00 calendar."""
    return _div(ms + F.lit(LOCAL_OFFSET_MS), DAY_MS)


def local_date(ms: Column) -> Column:
    return F.date_format(F.date_from_unix_date(local_day(ms).cast("int")), "yyyy-MM-dd")


def day_start_ms(date: Column) -> Column:
    """Start of a +08:00 date; a date that cannot be read starts at 0."""
    days = F.unix_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date")).cast("bigint")
    return F.coalesce(days * DAY_MS - LOCAL_OFFSET_MS, F.lit(0).cast("bigint"))


def day_end_ms(date: Column) -> Column:
    """Start of the next +08:00 date; a date that cannot be read never ends."""
    days = F.unix_date(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).cast("date")).cast("bigint")
    return F.coalesce((days + 1) * DAY_MS - LOCAL_OFFSET_MS, F.lit(2**63 - 1).cast("bigint"))


def number_epoch_ms(value: Column) -> Column:
    """A number is seconds below 1e11 and milliseconds otherwise."""
    return F.when(F.abs(value) < SECONDS_CUTOFF, value * 1000).otherwise(value)


# Fixed pattern: RFC 3339 date-time.
RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
)


def rfc3339_ms(text: Column) -> Column:
    """Epoch milliseconds of an RFC 3339 string, else null."""
    return F.when(text.rlike(RFC3339), F.unix_millis(F.try_to_timestamp(F.upper(text))))


def is_fresh(ts: Column, now: Column) -> Column:
    return (ts > 0) & (now - ts <= FRESH_MAX_AGE_MS)
