"""Date and time expressions; all instants are UTC."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

INVALID_FORMAT = "Error: Invalid Timestamp Format"
MICROS_PER_DAY = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(value: Any) -> Column:
    """A literal instant; a naive datetime is UTC whatever the machine's own zone."""
    if isinstance(value, datetime) and value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return value if isinstance(value, Column) else F.lit(value)


def from_epoch(c: Column | str) -> Column:
    """Epoch seconds (whole or fractional) to a timestamp."""
    return F.timestamp_seconds(_col(c))


def parse_timestamp(c: Column | str) -> Column:
    """Text to a timestamp; what cannot be read becomes null. Zoned text becomes its UTC instant."""
    return F.try_to_timestamp(_col(c))


def period_label(t: Column | str, start: Column | str, end: Column | str, pre: Column | str, post: Column | str) -> Column:
    """Where t lies around [start, end]; both ends belong to the event. Null is outside."""
    t, start, end, pre, post = map(_col, (t, start, end, pre, post))
    return (
        F.when(t.between(start, end), "During Event")
        .when((t >= pre) & (t < start), "Before Event")
        .when((t > end) & (t <= post), "After Event")
        .otherwise("Outside Window")
    )


def period_label_of_text(text: Column | str, start, end, pre, post) -> Column:
    """As period_label for raw text; text that is no timestamp gets the error label."""
    raw, parsed = _col(text), parse_timestamp(text)
    return F.when(raw.isNotNull() & parsed.isNull(), INVALID_FORMAT).otherwise(
        period_label(parsed, start, end, pre, post)
    )


def days_from_start(t: Column | str, start: Column | str) -> Column:
    """Whole days since start, floored: one microsecond before start is day -1."""
    delta = F.unix_micros(_col(t).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))
    return F.floor(delta / F.lit(MICROS_PER_DAY)).cast("bigint")


def hour_of_day(t: Column | str) -> Column:
    return F.hour(_col(t))


def weekday_name(t: Column | str) -> Column:
    return F.date_format(_col(t), "EEEE")


def add_time_features(df: DataFrame, t: str, hour: str = "comment_hour", weekday: str = "comment_day_of_week") -> DataFrame:
    """Hour and weekday; epoch numbers and text are coerced first, unreadable rows are dropped."""
    kind = dict(df.dtypes)[t]
    if kind == "string":
        df = df.withColumn(t, parse_timestamp(t))
    elif kind not in ("timestamp", "timestamp_ntz", "date"):
        df = df.withColumn(t, from_epoch(t))
    return df.dropna(subset=[t]).withColumns({hour: hour_of_day(t), weekday: weekday_name(t)})
