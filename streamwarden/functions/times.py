"""Time literals, epoch milliseconds and window arithmetic."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def event_time(literal) -> Column:
    """ISO text to timestamp; typed or untyped literals alike, null if unreadable."""
    return F.try_to_timestamp(F.col(literal) if isinstance(literal, str) else literal)


def epoch_ms(literal) -> Column:
    return F.unix_millis(event_time(literal))


def ts_ms(ts) -> Column:
    """Timestamp (with or without zone) to epoch milliseconds."""
    return F.unix_millis((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def iso_utc(ts) -> Column:
    """Timestamp to ISO-8601 UTC text with milliseconds (session zone is UTC)."""
    return F.date_format((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"), ISO_FORMAT)


def iso_from_ms(ms) -> Column:
    return iso_utc(F.timestamp_millis(F.col(ms) if isinstance(ms, str) else ms))


def moment(value: datetime | Column, kind="timestamp") -> Column:
    """A datetime as a literal in the session's zone, whatever the zone of this process."""
    return (F.lit(value.isoformat(sep=" ")) if isinstance(value, datetime) else value).cast(kind)


def bounds(start, end, kind="timestamp") -> tuple[Column, Column]:
    """A missing bound is the epoch or the current time."""
    return (moment(start if start is not None else F.timestamp_millis(F.lit(0)), kind),
            moment(end if end is not None else F.current_timestamp(), kind))


def in_range(df: DataFrame, ts: str, start, end) -> Column:
    """Closed range. Bounds take the column's own type, so that the filter reaches the scan."""
    low, high = bounds(start, end, df.schema[ts].dataType)
    return F.col(ts).between(low, high)


def span_ms(start, end) -> Column:
    """RANGE of a query that covers the whole span."""
    return ts_ms(end) - ts_ms(start)


def lookback_start(now, width_ms) -> Column:
    """Start of the history a new registration has to cover."""
    return F.timestamp_millis(ts_ms(now) - width_ms)
