"""Small sides of joins: broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_ROWS = 10_000


def materialize_small(df: DataFrame, max_rows: int = MAX_ROWS) -> tuple[DataFrame, bool]:
    """The rows as a local relation if there are at most max_rows, else df unchanged.

    At most max_rows + 1 rows reach the driver. The local copy is not recomputed by later plans.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def small_side(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """df marked for broadcast when its counted size allows; otherwise a plain side of a shuffle join."""
    local, small = materialize_small(df, max_rows)
    return F.broadcast(local) if small else df
