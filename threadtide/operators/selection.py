"""Row filters, column choice, defaults and input checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadtide.functions.temporal import instant
from threadtide.functions.text import is_blank, trim_unicode
from threadtide.schema import DELETED_AUTHOR


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(~is_blank(text))


def drop_deleted(df: DataFrame, author: str, marker: str = DELETED_AUTHOR) -> DataFrame:
    """Rows not by a deleted author; a null author stays."""
    return df.where(~F.col(author).eqNullSafe(marker))


def trim_and_drop_empty(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, trim_unicode(text)).where(F.col(text) != "")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with every column present (neither null nor NaN)."""
    return df.dropna(subset=list(columns))


def only_values(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Membership filter; no values means all rows."""
    return df.where(F.col(column).isin(list(values))) if values else df


def in_window(df: DataFrame, created: str, start: Any, end: Any) -> DataFrame:
    """Rows created in [start, end]; both ends included."""
    return df.where(F.col(created).between(instant(start), instant(end)))


def two_groups(df: DataFrame, group: str, value: str, first: Any, second: Any) -> DataFrame:
    """n, mean and variance of two named groups, side by side in one pass."""
    x = lambda g: F.when(F.col(group) == F.lit(g), F.col(value))
    stats = lambda i, g: [
        F.count(x(g)).alias(f"n{i}"), F.avg(x(g)).alias(f"mean{i}"), F.var_samp(x(g)).alias(f"var{i}")
    ]
    return df.agg(*stats(1, first), *stats(2, second))


def add_constants(df: DataFrame, **values: Any) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """The listed columns that exist and are numeric or boolean, in the given order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in (columns or df.columns) if isinstance(kinds.get(c), (T.NumericType, T.BooleanType))]


def with_defaults(df: DataFrame, defaults: Mapping[str, Column | Any]) -> DataFrame:
    """Add the columns that are absent; present columns stay as they are."""
    missing = {k: v if isinstance(v, Column) else F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


# What each optional column becomes where a source lacks it; unknown numbers are null.
FEATURE_DEFAULTS = {
    "processed_comment_body": "",
    "time_period": "Unknown",
    "post_type": "Other",
    "post_title_length": 0,
    "post_title_word_count": 0,
    "contains_team_name": False,
    "contains_player_keyword": False,
    "contains_hero_keyword": False,
    "contains_event_keyword": False,
}
NULL_NUMBERS = [
    "char_count", "word_count", "days_from_event_start",
    "neg_sentiment", "neu_sentiment", "pos_sentiment", "compound_sentiment",
]


def with_feature_defaults(df: DataFrame) -> DataFrame:
    nulls = {c: F.lit(None).cast("double") for c in NULL_NUMBERS}
    return with_defaults(df, {**FEATURE_DEFAULTS, **nulls})


def input_problem(df: DataFrame, columns: Sequence[str] = (), numeric: Sequence[str] = ()) -> str | None:
    """Why an analysis cannot run on df, or None. Looks at the schema only."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in [*columns, *numeric]:
        if c not in kinds:
            return f"Column '{c}' not found."
    for c in numeric:
        if not isinstance(kinds[c], (T.NumericType, T.BooleanType)):
            return f"Column '{c}' is not numeric."
    return None
