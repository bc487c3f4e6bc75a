"""Domain views over the driver tables, in Spark and (as text) in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadtide.operators import threads
from threadtide.functions import temporal
from threadtide.sources.events import EventWindow, event_dimension

ACTIVITY_EVENTS = [
    EventWindow("E1", datetime(2024, 1, 10), datetime(2024, 1, 15, 23, 59, 59)),
    EventWindow("E2", datetime(2024, 1, 12), datetime(2024, 1, 18, 23, 59, 59)),
]
POST_EVENTS = [
    EventWindow("O1", datetime(1997, 1, 1), datetime(1997, 3, 31, 23, 59, 59), "low"),
    EventWindow("O2", datetime(1997, 1, 1), datetime(1997, 3, 31, 23, 59, 59), "f"),
    EventWindow("O3", datetime(1998, 7, 1), datetime(1998, 7, 31, 23, 59, 59), "p"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its times as TIMESTAMP."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else df


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_orderdate").alias("post_created_utc"),
        F.col("o_totalprice").alias("post_score"), F.col("o_orderpriority").alias("post_title"),
        F.col("o_orderstatus").alias("selftext"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("post_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("comment_id"),
        F.col("l_shipdate").alias("comment_created_utc"), F.col("l_extendedprice").alias("comment_score"),
        "l_partkey", "l_suppkey",
    )


def threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.flatten_threads(posts(spark, sf_dir), comments(spark, sf_dir))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every activity row under every event with its period label."""
    events = event_dimension(spark, ACTIVITY_EVENTS)
    rows = threads.pair_with_events(activity(spark, sf_dir), events)
    return rows.withColumn(
        "time_period", temporal.period_label("ts", "start_ts", "end_ts", "pre_start_ts", "post_end_ts")
    )


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def seconds_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


EVENTS_SQL = """
  events_dim AS (
    SELECT event_name, start_ts, end_ts, start_ts - INTERVAL 7 DAY AS pre_start_ts, end_ts + INTERVAL 5 DAY AS post_end_ts
    FROM (VALUES ('E1', TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-15 23:59:59'),
                 ('E2', TIMESTAMP '2024-01-12 00:00:00', TIMESTAMP '2024-01-18 23:59:59')) v(event_name, start_ts, end_ts)
  )"""
PERIOD_SQL = """CASE WHEN ts BETWEEN start_ts AND end_ts THEN 'During Event'
       WHEN ts >= pre_start_ts AND ts < start_ts THEN 'Before Event'
       WHEN ts > end_ts AND ts <= post_end_ts THEN 'After Event' ELSE 'Outside Window' END"""
LABELLED_SQL = f"""{EVENTS_SQL},
  labelled AS (SELECT e.*, d.*, {PERIOD_SQL} AS time_period FROM events e CROSS JOIN events_dim d)"""
POST_EVENTS_SQL = """
  post_events AS (
    SELECT * FROM (VALUES ('O1', 'low', TIMESTAMP '1997-01-01 00:00:00', TIMESTAMP '1997-03-31 23:59:59'),
                          ('O2', 'f', TIMESTAMP '1997-01-01 00:00:00', TIMESTAMP '1997-03-31 23:59:59'),
                          ('O3', 'p', TIMESTAMP '1998-07-01 00:00:00', TIMESTAMP '1998-07-31 23:59:59'))
      v(event_name, query, start_ts, end_ts)
  )"""
