"""Per-row attribution of predictions: linear terms, and Shapley values of tree ensembles.

Tree attribution uses path-dependent expectations (Lundberg et al. 2018). For one leaf with value
v and path features j, each with cover share z_j and indicator o_j (the row satisfies all splits
on j), the Shapley value of f is

    v * (o_f - z_f) * integral over t in [0, 1] of prod_{j != f} (o_j * t + z_j * (1 - t))

The integrand is a polynomial, so a few Gauss-Legendre points evaluate the integral exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from threadtide.operators.boosting import Boosted
from threadtide.session import scratch_path
from threadtide.sources.tables import spread

ATTRIBUTION = "slot int, value double, shap double"
EFFECT = "slot int, mean_abs_shap double, mean_shap double, direction double, n bigint"
DEPENDENCE = "slot int, bin bigint, mean_value double, mean_shap double, n bigint"
#: Lists per slot in which the moments of tasks are merged first.
SHARES = 64


def linear_attribution(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """coefficient * (x - mean x) per column, as plain expressions."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients])).scalar()
    return df.withColumns({f"shap_{c}": F.lit(float(b)) * (F.col(c) - means[c]) for c, b in coefficients.items()})


def tree_nodes(spark, model) -> DataFrame:
    """The node table of a fitted tree ensemble, read from its saved form."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")


def _paths(root, children, leaf) -> list[tuple[float, list]]:
    """Per leaf of one tree its value and, per path feature, (slot, cover share, splits)."""
    out, stack = [], [(root, {})]
    while stack:
        at, path = stack.pop()
        split = children(at)
        if split is None:
            out.append((leaf(at), [(slot, share, splits) for slot, (share, splits) in path.items()]))
            continue
        slot, test, sides = split
        for child, goes_left, ratio in sides:
            share, splits = path.get(slot, (1.0, ()))
            stack.append((child, {**path, slot: (share * ratio, (*splits, (*test, goes_left)))}))
    return out


def _mllib_trees(nodes: Sequence[dict], weights: Sequence[float]) -> list[list[tuple[float, list]]]:
    trees = defaultdict(dict)
    for n in nodes:
        trees[n["treeID"]][n["id"]] = n

    def one(tree: int, by_id: dict) -> list[tuple[float, list]]:
        def children(at: int):
            node = by_id[at]
            if node["leftChild"] < 0:
                return None
            split = node["split"]
            test = (split["numCategories"] < 0, tuple(split["leftCategoriesOrThreshold"]))
            sides = [(c, left, by_id[c]["rawCount"] / node["rawCount"]) for c, left in ((node["leftChild"], True), (node["rightChild"], False))]
            return split["featureIndex"], test, sides

        return _paths(0, children, lambda at: weights[tree] * by_id[at]["prediction"])

    return [one(tree, by_id) for tree, by_id in trees.items()]


def _boosted_trees(model: Boosted) -> list[list[tuple[float, list]]]:
    def one(tree) -> list[tuple[float, list]]:
        def children(at: int):
            slot, left = tree.slot[at], tree.left[at]
            if slot < 0:
                return None
            threshold = float(model.bins.cuts[slot][tree.cut[at] - model.bins.first[slot]])
            return slot, (True, (threshold,)), [(c, c == left, tree.cover[c] / tree.cover[at]) for c in (left, left + 1)]

        return _paths(0, children, lambda at: tree.value[at])

    return [one(t) for t in model.trees]


@dataclass
class _Ensemble:
    """Leaves by tree, the slots that the trees use, and the mean that predictions start from."""

    trees: list[list[tuple[float, list]]]
    base: float

    def __post_init__(self) -> None:
        self.used = sorted({slot for tree in self.trees for _, terms in tree for slot, _, _ in terms})
        self.place = {slot: i for i, slot in enumerate(self.used)}

    def about(self, slots: Sequence[int]) -> _Ensemble:
        """The leaves that say something about some slots."""
        wanted = set(slots)
        return _Ensemble([[leaf for leaf in tree if any(s in wanted for s, _, _ in leaf[1])] for tree in self.trees], self.base)

    def attribute(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of the used slots; x holds their values, a row each."""
        x = np.asfortranarray(x)
        phi = np.zeros_like(x)
        for tree in self.trees:
            seen: dict = {}
            for value, terms in tree:
                if not terms or value == 0.0:
                    continue
                for slot, _, splits in terms:
                    if (slot, splits) not in seen:
                        seen[slot, splits] = _satisfied(x[:, self.place[slot]], splits).astype("float64")
                ones = [seen[slot, splits] for slot, _, splits in terms]
                points, weight = np.polynomial.legendre.leggauss((len(terms) + 1) // 2)
                inner = [0.0] * len(terms)
                for t, w in zip((points + 1) / 2, weight / 2):
                    factors = [o * t + share * (1 - t) for o, (_, share, _) in zip(ones, terms)]
                    whole = w * factors[0]
                    for factor in factors[1:]:
                        whole = whole * factor
                    for j, factor in enumerate(factors):
                        inner[j] = inner[j] + whole / factor
                for (slot, share, _), o, integral in zip(terms, ones, inner):
                    phi[:, self.place[slot]] += value * (o - share) * integral
        return phi


def _satisfied(x: np.ndarray, splits) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for continuous, values, goes_left in splits:
        left = x <= values[0] if continuous else np.isin(x, values)
        ok &= left if goes_left else ~left
    return ok


def _ensemble(spark, model) -> _Ensemble:
    """Trees of a fitted `boosting.Boosted` or an MLlib ensemble; their size is bounded by the model's parameters."""
    if isinstance(model, Boosted):
        trees, start = _boosted_trees(model), model.base
    else:
        nodes = tree_nodes(spark, model).toArrow().to_pylist()
        trees, start = _mllib_trees(nodes, list(getattr(model, "treeWeights", [1.0]))), 0.0
    means = (v * np.prod([share for _, share, _ in terms]) for tree in trees for v, terms in tree)
    return _Ensemble(trees, start + float(sum(means)))


def _scored(df: DataFrame, ensemble: _Ensemble, columns: Sequence[str], features: str, finish: Callable, schema: str) -> DataFrame:
    """What `finish` yields from the stream of (batch, values, Shapley values) of each task."""
    shared = df.sparkSession.sparkContext.broadcast(ensemble)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value

        def parts():
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)
                    yield batch, x, own.attribute(x)

        return finish(own, parts())

    sliced = VectorSlicer(inputCol=features, outputCol="_used", indices=ensemble.used).transform(df)
    return spread(sliced.select(*columns, vector_to_array("_used").alias("_x"))).mapInArrow(run, schema)


def tree_attribution(df: DataFrame, model, row_id: str, features: str = "features") -> tuple[DataFrame, float]:
    """(row_id, slot, value, shap) for every feature used by the trees, and the base value.

    Per row, base value + sum of shap = prediction. The leaves are bounded by the model's size
    (trees x nodes); they are broadcast, and rows are scored where they lie. `tree_effect` and
    `tree_dependence` do without these rows x slots.
    """
    spark = df.sparkSession
    ensemble = _ensemble(spark, model)
    used = ensemble.used
    if not used:
        return spark.createDataFrame([], df.select(row_id).schema).select(
            row_id, F.lit(0).alias("slot"), F.lit(0.0).alias("value"), F.lit(0.0).alias("shap")
        ), ensemble.base

    def long(own: _Ensemble, parts) -> Iterator[pa.RecordBatch]:
        for batch, x, phi in parts:
            rows = pa.array(np.repeat(np.arange(len(x)), len(own.used)))
            slots = pa.array(np.tile(np.array(own.used, "int32"), len(x)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), slots, pa.array(x.ravel()), pa.array(phi.ravel())], [row_id, "slot", "value", "shap"])

    return _scored(df, ensemble, [row_id], features, long, f"`{row_id}` {dict(df.dtypes)[row_id]}, {ATTRIBUTION}"), ensemble.base


def tree_sums(df: DataFrame, model, row_id: str, features: str = "features") -> DataFrame:
    """(row_id, base, shap): per row the base value and the sum of its attributions, whose total is the prediction."""
    ensemble = _ensemble(df.sparkSession, model)
    base = F.lit(ensemble.base).alias("base")
    if not ensemble.used:
        return df.select(row_id, base, F.lit(0.0).alias("shap"))

    def total(own: _Ensemble, parts) -> Iterator[pa.RecordBatch]:
        for batch, _, phi in parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(phi.sum(axis=1))], [row_id, "shap"])

    sums = _scored(df, ensemble, [row_id], features, total, f"`{row_id}` {dict(df.dtypes)[row_id]}, shap double")
    return sums.select(row_id, base, "shap")


@dataclass
class _Moments:
    """Counts, means, second moments and ranges of values and attributions, per slot."""

    n: int
    size: np.ndarray  # sum of |shap|
    mean: np.ndarray  # values, shap
    m2: np.ndarray
    co: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, phi: np.ndarray) -> _Moments:
        both = np.stack([x, phi])
        first = both[:, 0]
        apart = both - first[:, None]
        mean = apart.mean(axis=1)
        apart = apart - mean[:, None]
        return cls(
            len(x), np.abs(phi).sum(axis=0), first + mean, (apart * apart).sum(axis=1), (apart[0] * apart[1]).sum(axis=0),
            both.min(axis=1), both.max(axis=1),
        )

    def merged(self, other: _Moments) -> _Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        weight = self.n * other.n / n
        return _Moments(
            n, self.size + other.size, self.mean + gap * (other.n / n), self.m2 + other.m2 + gap * gap * weight,
            self.co + other.co + gap[0] * gap[1] * weight, np.minimum(self.low, other.low), np.maximum(self.high, other.high),
        )


MOMENTS = ["size", "mean_v", "mean_s", "m2_v", "m2_s", "co", "low_v", "low_s", "high_v", "high_s"]


def _merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Moments of the rows of each key as one, from the distances of their means to the common mean."""
    n = F.sum("n")
    mean = lambda c: (F.sum(F.col("n") * F.col(f"mean_{c}")) / n).alias(f"mean_{c}")
    held = parts.groupBy(*keys).agg(
        n.alias("n"), F.sum("size").alias("size"), mean("v"), mean("s"),
        *[f(c).alias(c) for f, c in ((F.min, "low_v"), (F.min, "low_s"), (F.max, "high_v"), (F.max, "high_s"))],
        F.collect_list(F.struct("n", "mean_v", "mean_s", "m2_v", "m2_s", "co")).alias("_parts"),
    )
    apart = lambda p, c: p[f"mean_{c}"] - F.col(f"mean_{c}")
    second = lambda m, a, b: F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p[m] + p["n"] * apart(p, a) * apart(p, b)).alias(m)
    return held.select(*keys, "n", "size", "mean_v", "mean_s", second("m2_v", "v", "v"), second("m2_s", "s", "s"), second("co", "v", "s"),
                       "low_v", "low_s", "high_v", "high_s")


def tree_effect(df: DataFrame, model, features: str = "features") -> DataFrame:
    """`global_effect` and the mean attribution per used slot, from one row per task and slot.

    slot, mean_abs_shap, mean_shap, direction (null where values or attributions do not vary), n. A task
    merges the moments of its batches, SHARES lists per slot merge those of the tasks. No rows give no slots.
    """
    spark = df.sparkSession
    ensemble = _ensemble(spark, model)
    if not ensemble.used:
        return spark.createDataFrame([], EFFECT)

    def moments(own: _Ensemble, parts) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x, phi in parts:
            part = _Moments.of(x, phi)
            total = part if total is None else total.merged(part)
        if total:
            k = len(own.used)
            columns = [total.size, *total.mean, *total.m2, total.co, *total.low, *total.high]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(own.used, "int32")), pa.array(np.full(k, total.n, np.int64)), *map(pa.array, columns)], ["slot", "n", *MOMENTS]
            )

    parts = _scored(df, ensemble, [], features, moments, "slot int, n bigint, " + ", ".join(f"{c} double" for c in MOMENTS))
    shared = parts.withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    whole = _merged(_merged(shared, "slot", "_share"), "slot")
    varies = (F.col("low_v") < F.col("high_v")) & (F.col("low_s") < F.col("high_s"))
    return whole.select(
        "slot", (F.col("size") / F.col("n")).alias("mean_abs_shap"), F.col("mean_s").alias("mean_shap"),
        F.when(varies, F.signum("co")).alias("direction"), "n",
    )


def tree_dependence(df: DataFrame, model, slots: Sequence[int], bins: int = 20, features: str = "features") -> DataFrame:
    """`dependence` of chosen slots (slot, bin, mean_value, mean_shap, n), from one row per task, slot and bin.

    Only leaves that say something about these slots are scored. Slots that no tree uses have no rows.
    """
    spark = df.sparkSession
    ensemble = _ensemble(spark, model).about(slots)
    chosen = [s for s in sorted(set(slots)) if s in ensemble.place]
    if not chosen:
        return spark.createDataFrame([], DEPENDENCE)
    values = VectorSlicer(inputCol=features, outputCol="_used", indices=chosen).transform(df).select(vector_to_array("_used").alias("_x"))
    at = [F.get("_x", F.lit(i)) for i in range(len(chosen))]
    limits = values.agg(*[f(c).alias(f"{name}{i}") for i, c in enumerate(at) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    low = np.array([limits[f"lo{i}"] for i in range(len(chosen))], float)
    width = (np.array([limits[f"hi{i}"] for i in range(len(chosen))], float) - low) / bins

    def binned(own: _Ensemble, parts) -> Iterator[pa.RecordBatch]:
        sums, columns = np.zeros((3, len(chosen) * bins)), [own.place[s] for s in chosen]
        for _, x, phi in parts:
            v, s = x[:, columns], phi[:, columns]
            place = np.where(width > 0, np.minimum((v - low) // np.where(width > 0, width, 1.0), bins - 1), 0).astype(np.int64)
            key = (place + np.arange(len(chosen)) * bins).ravel()
            for row, weight in zip(sums, (None, v.ravel(), s.ravel())):
                row += np.bincount(key, weight, len(row))
        some = np.flatnonzero(sums[0])
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(chosen, "int32")[some // bins]), pa.array(some % bins), pa.array(sums[0, some].astype(np.int64)), *(pa.array(r[some]) for r in sums[1:])],
                ["slot", "bin", "n", "value", "shap"],
            )

    parts = _scored(df, ensemble, [], features, binned, "slot int, bin bigint, n bigint, value double, shap double")
    n = F.sum("n")
    return parts.groupBy("slot", "bin").agg((F.sum("value") / n).alias("mean_value"), (F.sum("shap") / n).alias("mean_shap"), n.alias("n"))


def global_effect(attribution: DataFrame) -> DataFrame:
    """Per slot the mean absolute attribution and the sign of its link with the feature value."""
    link = F.try_divide(F.covar_samp("value", "shap"), F.stddev_samp("value") * F.stddev_samp("shap"))
    return attribution.groupBy("slot").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.signum(link).alias("direction"), F.count("shap").alias("n")
    )


def dependence(attribution: DataFrame, slots: Sequence[int], bins: int = 20) -> DataFrame:
    """Mean attribution per value bin of each chosen feature."""
    chosen = attribution.where(F.col("slot").isin(list(slots)))
    limits = chosen.groupBy("slot").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return (
        chosen.join(F.broadcast(limits), "slot")
        .groupBy("slot", place.cast("bigint").alias("bin"))
        .agg(F.avg("value").alias("mean_value"), F.avg("shap").alias("mean_shap"), F.count("shap").alias("n"))
    )
