"""Grouped summaries and pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadtide.functions.temporal import weekday_name
from threadtide.functions.numeric import known
from threadtide.functions.text import is_blank
from threadtide.operators.grid import densify
from threadtide.operators.quantiles import Located, grouped_quantiles, locate
from threadtide.schema import PERIODS, WEEKDAYS


def with_bounds(df: DataFrame) -> DataFrame:
    """mean - std and mean + std."""
    return df.withColumns(
        {"lower_bound": F.col("mean") - F.col("std"), "upper_bound": F.col("mean") + F.col("std")}
    )


def _median_table(df: DataFrame, keys: Sequence[str], metric: str, located: Located | None = None) -> DataFrame:
    return grouped_quantiles(df, keys, metric, [0.5], ["median"], located)


def _dense_summary(df: DataFrame, metric: str, grid: Mapping[str, Sequence | None]) -> DataFrame:
    keys = list(grid)
    found = locate(df, keys, metric, [0.5])
    table = with_bounds(_median_table(df, keys, metric, found)).select(
        *keys, "mean", "std", "median", "count", "lower_bound", "upper_bound"
    )
    return densify(table, grid, observed_in=found.stats)


def summary_by_period_and_event(df: DataFrame, metric: str, period: str = "time_period", event: str = "event_name") -> DataFrame:
    """mean/std/median/count/bounds; dense over the four periods and the observed events."""
    return _dense_summary(df, metric, {period: PERIODS, event: None})


def summary_by_type_and_event(
    df: DataFrame, metric: str, selected_types: Sequence[str] | None = None,
    post_type: str = "post_type", event: str = "event_name",
) -> DataFrame:
    """Same by post type and event; dense over observed types and events, optional type filter."""
    if selected_types:
        df = df.where(F.col(post_type).isin(list(selected_types)))
    return _dense_summary(df, metric, {post_type: None, event: None})


def summary_by_event(df: DataFrame, metric: str, event: str = "event_name") -> DataFrame:
    return with_bounds(_median_table(df, [event], metric)).select(
        event, "count", "mean", "median", "std", "min", "max", "lower_bound", "upper_bound"
    )


def summary_by(df: DataFrame, metric: str, x: str, hue: str) -> DataFrame:
    """mean/median/std/count by two free keys."""
    return _median_table(df, [x, hue], metric).select(x, hue, "mean", "median", "std", "count")


def summary_overall(df: DataFrame, metric: str) -> DataFrame:
    return with_bounds(_median_table(df, [], metric)).select(
        "mean", "median", "std", "count", "lower_bound", "upper_bound"
    )


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).count()


def column_name(value: str) -> str:
    return value.lower().replace(" ", "_")


def period_table(df: DataFrame, period: str = "time_period", event: str = "event_name") -> DataFrame:
    """Event x period counts (absent 0) and row percentages; counts first, then percentages."""
    counts = [F.count_if(F.col(period) == p).alias(column_name(p)) for p in PERIODS]
    known_rows = df.dropna(subset=[period, event]).where(F.col(period).isin(PERIODS))
    table = known_rows.groupBy(event).agg(*counts, F.count(period).alias("_all"))
    shares = [(F.lit(100.0) * F.col(column_name(p)) / F.col("_all")).alias(column_name(p) + "_pct") for p in PERIODS]
    return table.select(event, *[column_name(p) for p in PERIODS], *shares)


def mean_matrix(
    df: DataFrame, index: str, metric: str, columns: Sequence, event: str = "event_name", fill: float | None = None
) -> DataFrame:
    """Mean of metric, one row per index value and one column per event; absent cells null or fill."""
    out = df.dropna(subset=[index, event, metric]).groupBy(index).pivot(event, list(columns)).avg(metric)
    return out if fill is None else out.na.fill(fill, subset=[str(c) for c in columns])


def keyword_share(df: DataFrame, keyword: str, columns: Sequence, event: str = "event_name") -> DataFrame:
    """Percent of each event's rows that carry a keyword value; absent cells 0."""
    rows = df.dropna(subset=[keyword, event]).where(F.col(event).isin(list(columns)))
    counts = [F.count_if(F.col(event) == c).alias(f"_n{i}") for i, c in enumerate(columns)]
    table = rows.groupBy(keyword).agg(*counts)
    totals = table.agg(F.struct(*[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(columns))])).scalar()
    share = lambda i: F.coalesce(F.try_divide(F.lit(100.0) * F.col(f"_n{i}"), totals[f"_n{i}"]), F.lit(0.0))
    return table.select(keyword, *[share(i).alias(str(c)) for i, c in enumerate(columns)])


def engagement_by_weekday(df: DataFrame, created: str, metric: str, event: str = "event_name") -> DataFrame:
    """Mean metric per weekday and event, with the weekday's place in the week."""
    day = F.col("weekday")
    return (
        df.dropna(subset=[created, metric, event])
        .groupBy(weekday_name(created).alias("weekday"), event)
        .agg(F.avg(metric).alias("mean"))
        .withColumn("sort_idx", F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), day))
        .select("sort_idx", "weekday", event, "mean")
    )


def in_category_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Sort by a custom category order; values outside the list come last, by name."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), column)


def class_counts(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Rows per listed category, 0 and a warning flag for those without rows."""
    sizes = df.where(F.col(column).isin(list(categories))).groupBy(column).count()
    out = densify(sizes, {column: list(categories)}).na.fill(0, subset=["count"])
    return out.withColumn("is_empty", F.col("count") == 0)


def nonempty_texts(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.count_if(~is_blank(text)).alias("non_empty"), F.count(F.lit(1)).alias("rows"))


def require_text(df: DataFrame, text: str) -> DataFrame:
    """df itself, after checking that at least one text has content."""
    if df.where(~is_blank(text)).isEmpty():
        raise ValueError(f"no non-empty text in {text}")
    return df


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, count, unique, top, freq and, for numbers, moments and quartiles.

    Columns are unpivoted to (column, value) and counted once; the counts combine on the map side,
    so neither a hot value nor a wide table lands in one task.
    """
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    pairs = lambda cols, conv: F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), conv(c).alias("value")) for c in cols])
    )
    counts = (
        df.select(pairs([f.name for f in fields], lambda c: F.col(c).cast("string")))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("value").alias("n"))
    )
    shape = counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        # most frequent value; among equals the smallest
        F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v"))).alias("_top"),
    ).select("column", "count", "unique", F.col("_top")["v"].alias("top"), (-F.col("_top")["m"]).alias("freq"))
    types = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "column string, type string")
    out = F.broadcast(types).join(shape, "column", "left")
    if numeric:
        numbers = df.select(pairs(numeric, known))
        stats = grouped_quantiles(numbers, ["column"], "value", [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).drop("count")
        out = out.join(F.broadcast(stats), "column", "left")
    return out.na.fill(0, subset=["count", "unique"])


def cleaning_audit(
    df: DataFrame, steps: Sequence[tuple[str, Column]], before: tuple[str, Column] | None = None
) -> DataFrame:
    """Rows in, out and removed per step, in one pass; a row fails at its first false flag.

    ``before`` names the step that produced df and gives the number of rows that went into it.
    """
    alive = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("_0")]
    for i, (_, keep) in enumerate(steps, start=1):
        alive = alive & F.coalesce(keep, F.lit(False))
        aggs.append(F.count_if(alive).alias(f"_{i}"))
    counts = [F.col(f"_{i}") for i in range(len(steps) + 1)]
    names = [name for name, _ in steps]
    if before:
        names, counts = [before[0], *names], [before[1], *counts]
    first = 0 if before else 1
    rows = [
        F.struct(
            F.lit(first + i).alias("step_no"), F.lit(name).alias("step"),
            counts[i].alias("rows_in"), counts[i + 1].alias("rows_out"), (counts[i] - counts[i + 1]).alias("removed"),
        )
        for i, name in enumerate(names)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
