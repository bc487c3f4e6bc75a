"""Pearson correlation of many columns, pairwise complete."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threadtide.functions.numeric import known
from threadtide.operators.selection import numeric_columns

RESULT = "a string, b string, r double, n bigint"
#: Nodes of the first level of the tree that merges the partitions' moments.
LEAVES = 64


def _moments(x: np.ndarray) -> dict[str, np.ndarray]:
    """Per pair of columns of a batch (NaN: null): rows with both present, and means, squares and products around those means.

    Matrix products of values and null masks give all pairs at once. Values are taken relative to the first present one of
    their column, so large offsets do not cancel and a constant column has squares of exactly zero.
    """
    mask = ~np.isnan(x)
    shift = np.array([c[m][0] if m.any() else 0.0 for c, m in zip(x.T, mask.T)])
    there, v = mask.astype(float), np.where(mask, x - shift, 0.0)
    n, s, q, c = there.T @ there, v.T @ there, (v * v).T @ there, v.T @ v
    mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    return {"n": n, "mean": shift[:, None] + mean, "m2": np.maximum(q - s * mean, 0), "c": c - s * mean.T}


def _merged(one: dict[str, np.ndarray] | None, two: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of both parts together."""
    if one is None:
        return two
    n = one["n"] + two["n"]
    gap = np.where((one["n"] > 0) & (two["n"] > 0), two["mean"] - one["mean"], 0.0)
    share = np.divide(two["n"], n, out=np.zeros_like(n), where=n > 0)
    weight = one["n"] * share
    mean = np.where(one["n"] > 0, one["mean"] + gap * share, two["mean"])
    return {"n": n, "mean": mean, "m2": one["m2"] + two["m2"] + gap * gap * weight, "c": one["c"] + two["c"] + gap * gap.T * weight}


_PARTS = ("n", "mean", "m2", "c")
_MOMENTS = "node int, " + ", ".join(f"{p} array<double>" for p in _PARTS)


def _row(node: int, held: dict[str, np.ndarray]) -> pa.RecordBatch:
    lists = [pa.array([held[p].ravel()], pa.list_(pa.float64())) for p in _PARTS]
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), *lists], ["node", *_PARTS])


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """r and n of every unordered pair of numeric and boolean columns, over rows with both present.

    A constant column has no correlation: r is null. Every partition gives one short row of moments of all pairs, whatever
    its rows and however many pairs there are; rows of moments are merged up a tree.
    """
    columns = numeric_columns(df, columns)
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], RESULT)
    size = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = _merged(held, _moments(np.column_stack([c.fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in batch.columns])))
        if held is not None:
            yield _row(TaskContext.get().partitionId(), held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                held = _merged(held, {p: batch.column(p)[i].values.to_numpy().reshape(size, size) for p in _PARTS})
        if held is not None:
            yield _row(TaskContext.get().partitionId(), held)

    numbers = df.select(*[known(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    total = numbers.mapInArrow(partial, _MOMENTS)
    for nodes in (LEAVES, 1):
        total = total.repartition(F.col("node") % nodes).mapInArrow(merge, _MOMENTS)
    at = F.inline(F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(columns.index(a) * size + columns.index(b)).alias("ab"), F.lit(columns.index(b) * size + columns.index(a)).alias("ba"))
                            for k, (a, b) in enumerate(pairs)]))
    cells = total.select("n", "m2", "c", at).select("pair", *[F.get(p, F.col("ab")).alias(p) for p in ("n", "m2", "c")], F.get("m2", F.col("ba")).alias("other"))
    r = F.when((F.col("m2") > 0) & (F.col("other") > 0), F.col("c") / (F.sqrt("m2") * F.sqrt("other")))
    names = spark_pairs(df, pairs)
    return names.join(cells, "pair", "left").select("a", "b", r.alias("r"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def spark_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, a string, b string"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full symmetric matrix in long form (a, b, r, n), diagonal included."""
    columns = numeric_columns(df, columns)
    pairs = correlation_pairs(df, columns)
    if not columns:
        return pairs
    both = pairs.select(
        F.inline(F.array(F.struct("a", "b", "r", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r", "n")))
    )
    numbers = df.select(*[known(c).alias(c) for c in columns])
    stats = numbers.agg(*[F.struct(F.count(c).alias("n"), F.stddev_samp(c).alias("s")).alias(c) for c in columns])
    diagonal = stats.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(c)["s"] > 0, 1.0).alias("r"), F.col(c)["n"].alias("n"))
        for c in columns
    ])))
    return both.unionByName(diagonal)
