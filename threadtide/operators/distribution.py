"""Tables behind charts: histograms, densities, box statistics, count matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from threadtide.functions.numeric import known
from threadtide.functions.temporal import hour_of_day, weekday_name
from threadtide.operators import bounded
from threadtide.operators.grid import densify
from threadtide.operators.quantiles import group_moments, grouped_quantiles
from threadtide.operators.summary import group_sizes, in_category_order
from threadtide.schema import PERIODS, WEEKDAYS

# exp(-z*z/2) is exactly 0 in double precision beyond this z, so skipping such points is exact.
ZERO_DENSITY_Z = 38.7


def histogram(df: DataFrame, feature: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] of all rows, last bin closed; empty bins count 0.

    With ``by`` the groups share the bins. A constant feature gives the single bin 0.
    """
    keys = list(by)
    rows = df.select(*keys, known(feature).alias("_v")).dropna()
    limits = rows.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi"))).scalar()
    lo, hi = limits["lo"], limits["hi"]
    width = (hi - lo) / F.lit(bins)
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - lo) / width), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(*keys, place.cast("bigint").alias("bin")).count()
    grid = {**dict.fromkeys(keys), "bin": list(range(bins))}
    dense = densify(counts, grid).where(hi.isNotNull() & ((F.col("bin") == 0) | (hi > lo)))
    return dense.select(
        *keys, F.col("bin").cast("bigint").alias("bin"), (lo + F.col("bin") * width).alias("lo"),
        F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def kde_curve(df: DataFrame, feature: str, by: Sequence[str] = (), points: int = 200) -> DataFrame:
    """Gaussian density at equally spaced points from min to max, Scott bandwidth.

    Rows collapse to (value, count) first, and a value meets only the grid points that its kernel
    reaches in double precision; with many rows the bandwidth shrinks to a few points per value.
    Groups of one row, or without spread, have no curve.
    """
    keys = list(by)
    stats, small = bounded.materialize_small(
        group_moments(df, keys, feature)
        .where("std > 0")
        .select(
            *keys, F.col("count").alias("_n"), F.col("min").alias("_lo"), F.col("max").alias("_hi"),
            (F.pow(F.col("count").cast("double"), F.lit(-0.2)) * F.col("std")).alias("_h"),
            ((F.col("max") - F.col("min")) / (points - 1)).alias("_step"),
        )
    )
    hint = F.broadcast if small else (lambda side: side)
    counted = (
        df.select(*keys, known(feature).alias("_v")).dropna().groupBy(*keys, "_v").agg(F.count("_v").alias("_c"))
    )
    if keys:
        rows = counted.join(hint(stats), keys)
    else:
        fields = ["_n", "_lo", "_hi", "_h", "_step"]
        row = stats.select(F.struct(*fields).alias("s")).scalar()
        rows = counted.withColumns({f: row[f] for f in fields}).where("_h is not null")
    reach = F.lit(ZERO_DENSITY_Z) * F.col("_h")
    first = F.greatest(F.lit(0), F.floor((F.col("_v") - reach - F.col("_lo")) / F.col("_step")))
    last = F.least(F.lit(points - 1), F.ceil((F.col("_v") + reach - F.col("_lo")) / F.col("_step")))
    z = (F.col("_lo") + F.col("i") * F.col("_step") - F.col("_v")) / F.col("_h")
    sums = (
        rows.select("*", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("i"))
        .groupBy(*keys, "i")
        .agg(F.sum(F.col("_c") * F.exp(F.lit(-0.5) * z * z)).alias("_s"))
    )
    grid = stats.select(*keys, "_n", "_lo", "_hi", "_h", "_step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.when(F.col("i") == points - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("i") * F.col("_step"))
    density = F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return grid.join(sums, [*keys, "i"], "left").select(*keys, "i", x.alias("x"), density.alias("kde_density"))


def quartiles(df: DataFrame, feature: str, by: str = "event_name") -> DataFrame:
    return grouped_quantiles(df, [by], feature, [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).select(by, "q25", "q50", "q75")


def box_stats(df: DataFrame, feature: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the last point within 1.5 IQR, outlier count."""
    keys = list(by)
    quart = grouped_quantiles(df, keys, feature, [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).select(*keys, "q25", "q50", "q75")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    fences = bounded.small_side(quart.withColumns({"_lo": F.col("q25") - reach, "_hi": F.col("q75") + reach}))
    v = F.col("_v")
    inside = v.between(F.col("_lo"), F.col("_hi"))
    return (
        df.select(*keys, known(feature).alias("_v")).dropna()
        .join(fences, keys)
        .groupBy(*keys, "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
            F.count("_v").alias("count"),
        )
    )


def category_histogram(df: DataFrame, x: str, hue: str) -> DataFrame:
    return group_sizes(df, x, hue)


def weekday_hour_matrix(df: DataFrame, created: str) -> DataFrame:
    """Rows per weekday (in week order) and hour h00..h23, absent cells 0."""
    rows = df.select(weekday_name(created).alias("weekday"), hour_of_day(created).alias("_h"))
    table = rows.groupBy("weekday").agg(*[F.count_if(F.col("_h") == h).alias(f"h{h:02d}") for h in range(24)])
    dense = densify(table, {"weekday": WEEKDAYS})
    return in_category_order(dense.na.fill(0), "weekday", WEEKDAYS)


def line_table(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    """Mean of y per x and hue with the normal 95 % interval of the mean."""
    half = F.lit(1.96) * F.col("std") / F.sqrt("count")
    return (
        df.select(x, hue, known(y).alias("_v")).dropna()
        .groupBy(x, hue)
        .agg(F.avg("_v").alias("mean"), F.count("_v").alias("count"), F.stddev_samp("_v").alias("std"))
        .withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})
    )


def dual_histogram(df: DataFrame, feature1: str, feature2: str, bins: int = 30) -> DataFrame:
    """Histograms of two features over the rows where both are present."""
    rows = df.select(known(feature1).alias(feature1), known(feature2).alias(feature2)).dropna()
    parts = [histogram(rows, f, bins).withColumn("feature", F.lit(f)) for f in (feature1, feature2)]
    return parts[0].unionByName(parts[1]).select("feature", "bin", "lo", "hi", "count")


def period_counts(df: DataFrame, period: str = "time_period", event: str = "event_name") -> DataFrame:
    """Rows per period and event, periods in report order."""
    place = F.array_position(F.array(*[F.lit(p) for p in PERIODS]), F.col(period))
    sizes = group_sizes(df, period, event).where(F.col(period).isin(PERIODS))
    return sizes.select(place.alias("sort_idx"), period, event, "count").orderBy("sort_idx", event)
