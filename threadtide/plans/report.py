"""The full set of report tables and tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from threadtide.operators import correlation, distribution, hypothesis, summary
from threadtide.operators.selection import input_problem

# Features with their bin counts, and metrics of the grouped tables.
DISTRIBUTIONS = [("comment_score", 50), ("compound_sentiment", 30), ("word_count", 50)]
COMPARED = ["word_count", "compound_sentiment", "comment_score"]
PERIOD_METRICS = ["comment_score", "compound_sentiment"]
TYPE_METRICS = ["comment_score", "compound_sentiment", "word_count"]
WEEKDAY_METRICS = ["comment_score", "compound_sentiment"]


def report(df: DataFrame, selected_types: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Table name -> table. Tables whose columns are missing are left out; no selection means all types.

    The input is persisted (memory and disk), since every table reads it; unpersist it when done.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out: dict[str, DataFrame] = {}

    def add(name: str, columns: Sequence[str], build) -> None:
        if input_problem(df, columns) is None:
            out[name] = build()

    for feature, bins in DISTRIBUTIONS:
        add(f"dist_{feature}_summary", [feature], lambda: summary.summary_overall(df, feature))
        add(f"dist_{feature}_kde_curve", [feature], lambda: distribution.kde_curve(df, feature))
        add(f"dist_{feature}_histogram", [feature], lambda: distribution.histogram(df, feature, bins))
        add(f"dist_{feature}_histogram_by_event", [feature, "event_name"],
            lambda: distribution.histogram(df, feature, bins, ["event_name"]))
    for feature in COMPARED:
        add(f"dist_comp_{feature}_stats", [feature, "event_name"], lambda: summary.summary_by_event(df, feature))
        add(f"dist_comp_{feature}_quartiles", [feature, "event_name"], lambda: distribution.quartiles(df, feature))
        add(f"dist_comp_{feature}_density", [feature, "event_name"],
            lambda: distribution.kde_curve(df, feature, ["event_name"]))
    add("time_periods_table", ["time_period", "event_name"], lambda: summary.period_table(df))
    add("time_periods_counts", ["time_period", "event_name"], lambda: distribution.period_counts(df))
    for metric in PERIOD_METRICS:
        add(f"avg_{metric}_by_time_period_and_event", [metric, "time_period", "event_name"],
            lambda: summary.summary_by_period_and_event(df, metric))
    for metric in TYPE_METRICS:
        add(f"{metric}_by_post_type_and_event", [metric, "post_type", "event_name"],
            lambda: summary.summary_by_type_and_event(df, metric))
    add("word_count_by_selected_post_types", ["word_count", "post_type", "event_name"],
        lambda: summary.summary_by_type_and_event(df, "word_count", selected_types))
    add("pearson_correlation", [], lambda: correlation.correlation_matrix(df))
    for metric in WEEKDAY_METRICS:
        add(f"{metric}_by_weekday", [metric, "comment_created_utc", "event_name"],
            lambda: summary.engagement_by_weekday(df, "comment_created_utc", metric))
    return out


def standard_battery(events: Sequence[str]) -> list[tuple]:
    """The usual tests; events in report order (four: three neighbours of the first pairs, one twin pair)."""
    first, second, third, fourth = events
    t = lambda a, b: ("t_test", "event_name", "compound_sentiment", a, b)
    return [
        t(first, second), t(first, third), t(second, third), t(third, fourth),
        ("anova", "time_period", "comment_score"), ("anova", "time_period", "compound_sentiment"),
        ("anova", "post_type", "comment_score"), ("anova", "post_type", "compound_sentiment"),
        ("chi2", "time_period", "contains_question"), ("chi2", "event_name", "contains_team_name"),
    ]


def run_battery(df: DataFrame, specs: Sequence[tuple]) -> DataFrame:
    """All tests over one persisted input."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return hypothesis.battery(cached, specs)
    finally:
        cached.unpersist()
