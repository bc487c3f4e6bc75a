"""Exact quantiles and moments per group, without ever holding a group in one task.

``percentile`` keeps all distinct values of a group in one hash map. Here the first pass counts
values per group and *magnitude bucket* (sign, power of two, 1/256 steps), which combines on the
map side to a few thousand rows per group however large the group is. Those counts say in which
bucket each wanted rank lies; the second pass looks at the rows of these buckets only. Where such
a bucket holds too many rows for one task, the first pass is repeated with finer steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadtide.functions.numeric import known
from threadtide.operators import bounded

STEPS = 256
FINE_STEPS = 65_536
# Rows of one group whose values a single task may hold in a hash map.
MAX_GROUP_ROWS = 1_000_000
# Rows of one bucket that a single task may rank.
MAX_BUCKET_ROWS = 20_000_000
EXPONENT_SHIFT = 1100
LARGEST = 1.7976931348623157e308


def magnitude_bucket(x: Column, steps: int = STEPS) -> Column:
    """A bucket number that never decreases as x grows."""
    size = F.least(F.abs(x), F.lit(LARGEST))
    power = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * steps)
    step = F.greatest(F.lit(0), F.least(F.lit(steps - 1), step))
    code = (power + EXPONENT_SHIFT) * steps + step + 1
    return F.when(x == 0, F.lit(0).cast("bigint")).when(x > 0, code).otherwise(-code)


def _values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with every key and the value present; the value as double named _v."""
    out = df.select(*keys, known(value).alias("_v"))
    return out.dropna(subset=[*keys, "_v"])


def _rank_names(i: int) -> tuple[str, str]:
    return f"_lo{i}", f"_hi{i}"


def group_moments(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float] = (), steps: int = STEPS
) -> DataFrame:
    """One row per group: count, mean, std, min, max and, per prob, the buckets of its two ranks."""
    part = Window.partitionBy(*keys)
    per_bucket = (
        _values(df, keys, value)
        .groupBy(*keys, magnitude_bucket(F.col("_v"), steps).alias("_b"))
        .agg(
            F.count("_v").alias("_n"),
            F.avg("_v").alias("_m"),
            F.var_pop("_v").alias("_var"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
        )
        .withColumn("_upto", F.sum("_n").over(part.orderBy("_b")))
        .withColumn("_total", F.sum("_n").over(part))
        .withColumn("_mu", F.sum(F.col("_n") * F.col("_m")).over(part) / F.col("_total"))
    )
    spread = F.sum(F.col("_n") * (F.col("_var") + F.pow(F.col("_m") - F.col("_mu"), F.lit(2.0))))
    n = F.max("_total")
    aggs = [
        n.alias("count"),
        F.max("_mu").alias("mean"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"),
        F.min("_min").alias("min"),
        F.max("_max").alias("max"),
    ]
    for i, p in enumerate(probs):
        place = (F.col("_total") - 1) * F.lit(float(p))
        for name, rank in zip(_rank_names(i), (F.floor(place) + 1, F.ceil(place) + 1)):
            # min over structs: the first bucket whose running count reaches the rank
            reached = F.when(
                F.col("_upto") >= rank,
                F.struct(
                    F.col("_b").alias("b"),
                    (rank - (F.col("_upto") - F.col("_n"))).cast("bigint").alias("rank"),
                    (place - F.floor(place)).alias("frac"),
                    F.col("_n").alias("size"),
                ),
            )
            aggs.append(F.min(reached).alias(name))
    return per_bucket.groupBy(*keys).agg(*aggs)


def _fullest_bucket(stats: DataFrame, small: bool, n_probs: int) -> int:
    """Rows of the largest bucket that holds a wanted rank; local rows are read without a job."""
    sizes = F.greatest(*[F.col(name)["size"] for i in range(n_probs) for name in _rank_names(i)], F.lit(0))
    table = stats.select(sizes.alias("n")) if small else stats.agg(F.max(sizes).alias("n"))
    return max((n or 0 for n in table.toArrow().to_pydict()["n"]), default=0)


@dataclass(frozen=True)
class Located:
    """What the first pass found: moments and rank places per group, and how finely it looked.

    Without stats every group fits one task.
    """

    stats: DataFrame | None
    small: bool
    steps: int


def locate(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    max_local_groups: int = bounded.MAX_ROWS,
    max_bucket_rows: int = MAX_BUCKET_ROWS,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> Located:
    """Run the first pass. Up to max_local_groups group rows are kept as a local relation, more are persisted."""
    sizes = _values(df, keys, value).groupBy(*keys).agg(F.count("_v").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= max_group_rows:
        return Located(None, False, STEPS)
    stats, small = bounded.materialize_small(group_moments(df, keys, value, probs), max_local_groups)
    if not small:
        stats = stats.persist(StorageLevel.MEMORY_AND_DISK)
    if probs and _fullest_bucket(stats, small, len(probs)) > max_bucket_rows:
        fine = group_moments(df, keys, value, probs, FINE_STEPS)
        return Located(*bounded.materialize_small(fine, max_local_groups), FINE_STEPS)
    return Located(stats, small, STEPS)


def _built_in(values: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The same columns for groups that fit a task each."""
    moments = [F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max")]
    rows = values.groupBy(*keys).agg(*moments, F.percentile("_v", [float(p) for p in probs] or [0.5]).alias("_q"))
    return rows.where("count > 0").select(*keys, "count", "mean", "std", "min", "max", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(names)])


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    located: Located | None = None,
    **limits: int,
) -> DataFrame:
    """Per group: count, mean, std, min, max and the exact quantiles (linear interpolation).

    Rows with a null key or a null/NaN value are left out. ``std`` is the sample deviation, null
    for a single row. Few groups are broadcast into the second pass; with more groups than the
    limit it is a shuffle join on (keys, bucket).
    """
    keys = list(keys)
    found = located or locate(df, keys, value, probs, **limits)
    stats, small = found.stats, found.small
    base = ["count", "mean", "std", "min", "max"]
    if stats is None:
        return _built_in(_values(df, keys, value), keys, probs, names)
    if not probs:
        return stats.select(*keys, *base)
    hint = F.broadcast if small else (lambda side: side)

    ranks = stats.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_p"),
                        F.lit(side).alias("_side"),
                        F.col(name)["b"].alias("_b"),
                        F.col(name)["rank"].alias("_rank"),
                        F.col(name)["frac"].alias("_frac"),
                    )
                    for i in range(len(probs))
                    for side, name in enumerate(_rank_names(i))
                ]
            )
        ),
    )
    place = [*keys, "_b"]
    wanted = hint(ranks.select(*place))
    rows = _values(df, keys, value).withColumn("_b", magnitude_bucket(F.col("_v"), found.steps))
    count = lambda d: d.groupBy(*place, "_v").agg(F.count("_v").alias("_n"))
    # a broadcast filters before the shuffle; a shuffle join meets rows already combined per value
    counted = count(rows.join(wanted, place, "left_semi")) if small else count(rows).join(wanted, place, "left_semi")
    candidates = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*place).orderBy("_v")))
    picked = candidates.join(hint(ranks), place).where(
        (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
    )
    at = lambda i, side: F.max(F.when((F.col("_p") == i) & (F.col("_side") == side), F.col("_v")))
    frac = lambda i: F.max(F.when(F.col("_p") == i, F.col("_frac")))
    quantiles = picked.groupBy(*keys).agg(
        *[(at(i, 0) + (at(i, 1) - at(i, 0)) * frac(i)).alias(name) for i, name in enumerate(names)]
    )
    if keys:
        joined = quantiles.join(hint(stats.select(*keys, *base)), keys)
    else:
        # one row on each side: ride the moments along as a scalar
        row = stats.select(F.struct(*base).alias("s")).scalar()
        joined = quantiles.withColumns({c: row[c] for c in base})
    return joined.select(*keys, *base, *names)
