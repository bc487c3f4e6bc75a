"""The event dimension."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

PRE_DAYS = 7
POST_DAYS = 5


@dataclass(frozen=True)
class EventWindow:
    """A named date window (naive datetimes are UTC) and the words that find its posts."""

    event_name: str
    start: datetime
    end: datetime
    query: str = ""


def _micros(t: datetime) -> int:
    return calendar.timegm(t.utctimetuple()) * 1_000_000 + t.microsecond


def event_dimension(
    spark: SparkSession, windows: Sequence[EventWindow], pre_days: int = PRE_DAYS, post_days: int = POST_DAYS
) -> DataFrame:
    """event_name, query, start_ts, end_ts and the derived pre_start_ts and post_end_ts."""
    table = pa.table(
        {
            "event_name": pa.array([w.event_name for w in windows], pa.string()),
            "query": pa.array([w.query for w in windows], pa.string()),
            "s": pa.array([_micros(w.start) for w in windows], pa.int64()),
            "e": pa.array([_micros(w.end) for w in windows], pa.int64()),
        }
    )
    named = spark.createDataFrame(table).select(
        "event_name", "query", F.timestamp_micros("s").alias("start_ts"), F.timestamp_micros("e").alias("end_ts")
    )
    return with_windows(named, pre_days, post_days)


def with_windows(events: DataFrame, pre_days: int = PRE_DAYS, post_days: int = POST_DAYS) -> DataFrame:
    """Add pre_start_ts = start_ts - pre_days and post_end_ts = end_ts + post_days."""
    return events.withColumns(
        {
            "pre_start_ts": F.col("start_ts") - F.make_dt_interval(F.lit(pre_days)),
            "post_end_ts": F.col("end_ts") + F.make_dt_interval(F.lit(post_days)),
        }
    )
