"""Least squares over any columns, dependent ones too, by triangular factors that are merged up a tree.

Every partition turns its rows [1, features, label] into the triangular factor of their QR decomposition; factors on top of each
other are rows again, so they merge by the same step. The first column takes the means out of all others, so the rest of
the factor belongs to the centred data, and its singular values give the shortest solution. One pass over the rows serves
several fits: rows are factored by cell (a fold, a split), and a fit is the merger of its cells.

A factor of d features holds (d + 2)^2 doubles (0.25 GB for 5,500), a task a few of them. The rows themselves stay sparse up to the
task. Only coefficients reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

#: Singular values below this share of the largest one count as zero.
CUT = 1e-10
#: Centred columns below this share of their own length are constant.
CONSTANT = 1e-12
#: Bytes of factors that one merge holds at most (two factors in any case).
MERGE_BYTES = 1 << 28
#: Partitions that the tree of merges is laid out for; more only widen its first level.
PARTITIONS = 4096

FACTOR = "cell int, node int, factor array<double>"
FITS = "fit string, n bigint, rank int, intercept double, coefficients array<double>"


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows [1, features, label] of a batch of (cell, slots, values, label)."""
    out = np.zeros((batch.num_rows, width))
    lengths = pc.list_value_length(batch.column("slots")).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(batch.num_rows), lengths)
    out[at, batch.column("slots").flatten().to_numpy() + 1] = batch.column("values").flatten().to_numpy()
    out[:, 0] = 1.0
    out[:, -1] = batch.column("label").to_numpy()
    return out


def _row(cell: int, node: int, factor: np.ndarray) -> pa.RecordBatch:
    values = pa.array([factor.ravel()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([node], pa.int32()), values], ["cell", "node", "factor"])


def _parts(features: str) -> tuple[Column, Column]:
    """Slots and values of a vector column, sparse or dense."""
    v = F.unwrap_udt(features)
    every = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    return F.coalesce(v["indices"], F.when(F.size(v["values"]) > 0, every).otherwise(F.array().cast("array<int>"))), v["values"]


def factors(df: DataFrame, label: str, cell: Column | None = None, features: str = "features", size: int | None = None) -> DataFrame:
    """(cell, factor): one triangular factor per cell, an int per row that takes few values; null cells take no part.

    Rows without a label (null or NaN) or without features take no part.
    """
    if size is None:
        size = vector_size(df, features)
    width = size + 2
    slots, values = _parts(features)
    y = F.nanvl(F.col(label).cast("double"), F.lit(None).cast("double"))
    rows = df.where(F.col(features).isNotNull()).select(
        (F.lit(0) if cell is None else cell).cast("int").alias("cell"), slots.alias("slots"), values.alias("values"), y.alias("label"),
    ).dropna()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        step = max(width, 256)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                cells, block = part.column("cell").to_numpy(), _dense(part, width)
                for k in np.unique(cells).tolist():
                    mine = block[cells == k]
                    held[k] = _factor(np.vstack([held[k], mine]) if k in held else mine)
        for k, factor in held.items():
            yield _row(k, TaskContext.get().partitionId(), factor)

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_row(table.column("cell")[0].as_py(), table.column("node")[0].as_py(), _stacked(table, width))])

    fan = int(min(64, max(2, MERGE_BYTES // (8 * width * width))))
    levels = [1]
    while levels[-1] * fan < PARTITIONS:
        levels.append(levels[-1] * fan)
    total = rows.mapInArrow(partial, FACTOR)
    for nodes in reversed(levels):
        total = total.withColumn("node", F.col("node") % nodes).groupBy("cell", "node").applyInArrow(merge, FACTOR)
    return total.select("cell", "factor")


def _stacked(table: pa.Table, width: int) -> np.ndarray:
    """The factor of all factors of a table, two at a time."""
    out = None
    for factor in table.column("factor"):
        rows = factor.values.to_numpy().reshape(-1, width)
        out = rows if out is None else _factor(np.vstack([out, rows]))
    return out


def _solved(factor: np.ndarray, cut: float) -> tuple[int, float, np.ndarray]:
    """Rank, intercept and shortest coefficients of the centred rows behind a factor."""
    means = factor[0, 1:] / factor[0, 0]
    a, y = factor[1:, 1:-1].copy(), factor[1:, -1]
    if a.size:
        a[:, np.linalg.norm(a, axis=0) <= CONSTANT * np.linalg.norm(factor[:, 1:-1], axis=0)] = 0.0
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    keep = s > cut * s.max(initial=0.0)
    slopes = vt[keep].T @ ((u[:, keep].T @ y) / s[keep])
    return int(keep.sum()), float(means[-1] - means[:-1] @ slopes), slopes


def solve(factored: DataFrame, fits: Mapping[str, Sequence[int]], size: int, cut: float = CUT) -> DataFrame:
    """(fit, n, rank, intercept, coefficients) of each fit, a list of the cells whose rows it takes; a fit without rows has no row."""
    width = size + 2

    def run(table: pa.Table) -> pa.Table:
        factor = _stacked(table, width)
        rank, intercept, slopes = _solved(factor, cut)
        return pa.table({
            "fit": pa.array([table.column("fit")[0].as_py()]), "n": pa.array([int(round(factor[0, 0] ** 2))], pa.int64()),
            "rank": pa.array([rank], pa.int32()), "intercept": [intercept],
            "coefficients": pa.array([slopes], pa.list_(pa.float64())),
        })

    wanted = [(name, int(c)) for name, cells in fits.items() for c in cells]
    pairs = factored.sparkSession.createDataFrame(wanted, "fit string, cell int")
    return factored.join(F.broadcast(pairs), "cell").select("fit", "factor").groupBy("fit").applyInArrow(run, FITS)


def vector_size(df: DataFrame, features: str = "features") -> int:
    """The length of the vectors of a column."""
    v = F.unwrap_udt(features)
    row = df.where(F.col(features).isNotNull()).select(F.coalesce(v["size"], F.size(v["values"])).alias("n")).first()
    if row is None:
        raise ValueError("no rows to fit")
    return row["n"]


def linear_prediction(features: str, intercept: float, coefficients: Sequence[float]) -> Column:
    """intercept + features . coefficients, in the JVM."""
    slots, values = _parts(features)
    weights = F.lit([float(c) for c in coefficients])
    terms = F.zip_with(slots, values, lambda i, x: x * F.get(weights, i))
    return F.lit(float(intercept)) + F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def fold_fits(df: DataFrame, label: str, fold: str, test: str | None = None, features: str = "features", cut: float = CUT) -> dict:
    """All fits of a cross validation from one pass over the rows.

    Gives {fold: fit on the rows of all other folds}, and under None the fit on the rows whose test flag is false. Each fit is a Row
    of FITS. The vectors must be the same for all fits: scaling changes no prediction, a vocabulary learned on held-out rows would.
    """
    size = vector_size(df, features)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)
    place = {k: i for i, k in enumerate(folds)}
    held = F.coalesce(F.col(test), F.lit(False)).cast("int") if test else F.lit(0)
    cell = 2 * sum((F.col(fold) > k).cast("int") for k in folds[:-1]) + held if len(folds) > 1 else held
    fits: dict[str, list[int]] = {str(k): [2 * i + t for j, i in place.items() if j != k for t in (0, 1)] for k in folds}
    fits[""] = [2 * i for i in place.values()]
    rows = solve(factors(df, label, cell, features, size), fits, size, cut).collect()
    names = {str(k): k for k in folds} | {"": None}
    return {names[r["fit"]]: r for r in rows}


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    pass


class LeastSquares(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Ordinary least squares with an intercept; of all best solutions the one with the shortest coefficients."""

    cut = Param(Params._dummy(), "cut", "share of the largest singular value that counts as zero", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", featuresCol: str = "features", predictionCol: str = "prediction", cut: float = CUT):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(labelCol="label", featuresCol="features", predictionCol="prediction", cut=CUT)

    def _fit(self, df: DataFrame) -> LeastSquaresModel:
        label, features = self.getLabelCol(), self.getFeaturesCol()
        size = vector_size(df, features)
        row = solve(factors(df, label, None, features, size), {"all": [0]}, size, self.getOrDefault(self.cut)).first()
        if row is None:
            raise ValueError(f"no row has a {label}")
        return LeastSquaresModel(coefficients=row["coefficients"], intercept=row["intercept"], rank=row["rank"],
                                 featuresCol=features, predictionCol=self.getPredictionCol())


class LeastSquaresModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted coefficients; saved and loaded with the pipeline that holds it."""

    slopes = Param(Params._dummy(), "slopes", "one coefficient per slot", TypeConverters.toListFloat)
    constant = Param(Params._dummy(), "constant", "prediction where all slots are zero", TypeConverters.toFloat)
    found_rank = Param(Params._dummy(), "found_rank", "independent columns", TypeConverters.toInt)

    def __init__(self, coefficients=None, intercept=None, rank=None, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(featuresCol=featuresCol, predictionCol=predictionCol)
        if coefficients is not None:
            self._set(slopes=[float(c) for c in coefficients], constant=float(intercept), found_rank=int(rank))

    @property
    def coefficients(self) -> np.ndarray:
        return np.array(self.getOrDefault(self.slopes))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.constant)

    @property
    def rank(self) -> int:
        return self.getOrDefault(self.found_rank)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getPredictionCol(), linear_prediction(self.getFeaturesCol(), self.intercept, self.coefficients))
