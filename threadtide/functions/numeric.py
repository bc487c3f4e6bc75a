"""Numeric row expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECONDS_PER_DAY = 86400.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def score_per_day(score: Column | str, created: Column | str, parent_created: Column | str) -> Column:
    """Score per day since the parent; the bare score where no time has passed or a time is missing."""
    score = _col(score).cast("double")
    micros = F.unix_micros(_col(created).cast("timestamp")) - F.unix_micros(_col(parent_created).cast("timestamp"))
    days = micros / F.lit(1e6 * SECONDS_PER_DAY)
    return F.when(days > 0, score / days).otherwise(score)


def score_ratio(score: Column | str, parent_score: Column | str) -> Column:
    """score / (parent_score + 1); a null or zero parent score gives the score, or 0 without one.

    A parent score of -1 has no ratio and gives null.
    """
    s, ps = _col(score).cast("double"), _col(parent_score)
    return F.when(ps.isNotNull() & (ps != 0), F.try_divide(s, ps + F.lit(1))).otherwise(
        F.coalesce(s, F.lit(0.0))
    )


def finite(c: Column | str, inf: float = 1e10) -> Column:
    """NaN to 0 and the infinities to +-inf; null stays null."""
    x = _col(c)
    return (
        F.when(F.isnan(x), 0.0)
        .when(x == float("inf"), inf)
        .when(x == float("-inf"), -inf)
        .otherwise(x)
    )


def known(c: Column | str) -> Column:
    """The value as double with NaN as null."""
    x = _col(c).cast("double")
    return F.when(~F.isnan(x), x)
