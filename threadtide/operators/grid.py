"""Dense grids: every combination of category values, absent cells null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from threadtide.operators.bounded import materialize_small


# Parts that a large key's values are copied to, so that the grid is made by many tasks.
PARTS = 32


def _spanned(base: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Every row of base with every value of a one-column table."""
    local, small = materialize_small(values)
    if small:
        listed = [row[key] for row in local.collect()]
        kind = values.schema[key].dataType
        return base.withColumn(key, F.explode(F.array(*[F.lit(v).cast(kind) for v in listed]).cast(f"array<{kind.simpleString()}>")))
    copied = values.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return base.withColumn("_part", F.pmod(F.xxhash64(*base.columns), F.lit(PARTS)).cast("int")).join(copied, "_part").drop("_part")


def densify(table: DataFrame, grid: Mapping[str, Sequence | None], observed_in: DataFrame | None = None) -> DataFrame:
    """Left-join a grouped table onto the full grid of its keys.

    A key with listed values spans that list; a key mapped to None spans the observed values. Null is
    no category of any key. The grid is exploded from arrays, or where a key has very many values
    joined in parts.

    Observed values come from observed_in, any cheap table with the same groups. Without one they
    come from the table, which is then kept as a local relation where it is small: otherwise the
    work behind it would run once for the grid and once for the cells.
    """
    keys = list(grid)
    observed = [k for k, values in grid.items() if values is None]
    spark = table.sparkSession
    if observed:
        if observed_in is None:
            table, _ = materialize_small(table)
            observed_in = table
        values_of = lambda key: observed_in.select(key).where(F.col(key).isNotNull()).distinct()
        base = values_of(observed[0])
        for key in observed[1:]:
            base = _spanned(base, values_of(key), key)
    else:
        base = spark.range(1).select()
    for key, values in grid.items():
        if values is not None:
            base = base.withColumn(key, F.explode(F.array(*[F.lit(v) for v in values])))
    return base.select(*keys).join(table, keys, "left")
