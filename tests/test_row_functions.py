import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadtide.functions import numeric, temporal
from threadtide.operators import selection, threads
from threadtide.sources.events import EventWindow, event_dimension

START, END = datetime(2024, 1, 10, 12), datetime(2024, 1, 15, 23, 59, 59)
MICRO = timedelta(microseconds=1)


def dimension(spark):
    return event_dimension(spark, [EventWindow("E", START, END)])


def test_period_edges(spark):
    pre, post = START - timedelta(days=7), END + timedelta(days=5)
    cases = [
        (START, "During Event"), (START - MICRO, "Before Event"), (END, "During Event"), (END + MICRO, "After Event"),
        (pre, "Before Event"), (pre - MICRO, "Outside Window"), (post, "After Event"), (post + MICRO, "Outside Window"), (None, "Outside Window"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t timestamp")
    label = temporal.period_label("t", "start_ts", "end_ts", "pre_start_ts", "post_end_ts")
    got = threads.pair_with_events(rows, dimension(spark)).select("i", label.alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == [p for _, p in cases]


def test_days_are_floored(spark):
    times = [START, START - MICRO, START + timedelta(hours=13), START - timedelta(days=1), START + timedelta(days=2) - MICRO, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp")
    days = rows.select("i", temporal.days_from_start("t", temporal.instant(START)).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in days] == [0, -1, 0, -1, 1, None]


def test_text_times(spark):
    raw = ["2024-01-01T00:00:00", "garbage", None, "2024-01-11", "2024-01-12T01:00:00+02:00"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    label = temporal.period_label_of_text("raw", "start_ts", "end_ts", "pre_start_ts", "post_end_ts")
    got = threads.pair_with_events(rows, dimension(spark)).select("i", label.alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == ["Outside Window", temporal.INVALID_FORMAT, "Outside Window", "During Event", "During Event"]
    kept = temporal.add_time_features(rows, "raw").orderBy("i").collect()
    assert [(r["i"], r["comment_hour"], r["comment_day_of_week"]) for r in kept] == [(0, 0, "Monday"), (3, 0, "Thursday"), (4, 23, "Thursday")]


def test_epoch_numbers_are_coerced(spark):
    rows = spark.createDataFrame([(1, 1704067200), (2, None)], "i int, t bigint")
    got = temporal.add_time_features(rows, "t").collect()
    assert [(r["i"], r["comment_hour"], r["comment_day_of_week"]) for r in got] == [(1, 0, "Monday")]


def test_score_per_day(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 10, t, t), (2, 10, t, t + timedelta(days=1)), (3, 10, t + timedelta(hours=12), t), (4, 10, None, t), (5, None, t + MICRO, t)]
    df = spark.createDataFrame(rows, "i int, s bigint, c timestamp, p timestamp")
    got = df.select("i", numeric.score_per_day("s", "c", "p").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [10.0, 10.0, 20.0, 10.0, None]


def test_score_ratio(spark):
    rows = [(1, 10, None), (2, 10, 0), (3, 10, -1), (4, 10, 9), (5, None, 9), (6, None, 0)]
    df = spark.createDataFrame(rows, "i int, s bigint, p bigint")
    got = df.select("i", numeric.score_ratio("s", "p").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [10.0, 10.0, None, 1.0, None, 0.0]


def test_finite(values):
    got = values([math.nan, math.inf, -math.inf, None, 2.5], numeric.finite, "x double")
    assert got == [0.0, 1e10, -1e10, None, 2.5]


def test_defaults_and_checks(spark):
    df = spark.createDataFrame([(1, "x")], "a int, post_type string")
    full = selection.with_feature_defaults(df)
    row = full.first()
    assert (row["post_type"], row["time_period"], row["char_count"], row["contains_team_name"]) == ("x", "Unknown", None, False)
    assert selection.input_problem(df, ["a"], ["post_type"]) == "Column 'post_type' is not numeric."
    assert selection.input_problem(df, ["b"]) == "Column 'b' not found."
    assert selection.input_problem(df, ["post_type"], ["a"]) is None
    assert selection.numeric_columns(df) == ["a"]


def test_naive_bounds_are_utc(spark):
    df = spark.range(1).select(temporal.instant(datetime(2024, 1, 1)).alias("t")).select(F.unix_seconds("t").alias("s"))
    assert df.first()["s"] == 1704067200
