"""Bootstrap intervals of group means, in one pass over the rows.

Drawing n rows with repeats gives every row a count that is close to Poisson(1), and rows then draw their counts without
knowing each other. A count is a function of the row's id and the replicate, so a task that runs again draws the same. Every
task adds up counts and weighted values of all replicates per group; these short rows are merged in two steps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threadtide.functions.numeric import known

REPLICATES = 1000
#: A prime below 2^31: products of two numbers below it fit 63 bits.
PRIME = 2**31 - 1
#: Counts beyond this have a probability of under 1e-12.
MOST = 13
#: Numbers that a task holds in one step over its rows, and in sums of groups before it hands them on.
CELLS = 1 << 22
#: Nodes of the first merge.
NODES = 64

SUMS = "node int, key string, weights array<double>, sums array<double>"


def steps() -> list[float]:
    """Upper bounds of the uniform number for counts 0, 1, 2, ..."""
    mass = [math.exp(-1) / math.factorial(k) for k in range(MOST)]
    return [math.fsum(mass[: k + 1]) for k in range(MOST)]


def _multipliers(replicates: int, seed: int) -> np.ndarray:
    """Three numbers per replicate, from its number and the seed."""
    number = lambda part, r: int(hashlib.md5(f"{seed}|{part}|{r}".encode()).hexdigest()[:8], 16) % PRIME
    return np.array([[number(part, r) for r in range(replicates)] for part in ("a", "b", "c")], dtype=np.int64)


def _counts(high: np.ndarray, low: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Rows x replicates: how often a replicate draws a row."""
    a, b, c = multipliers
    mixed = ((high[:, None] * a + c) % PRIME + low[:, None] * b) % PRIME
    return np.searchsorted(np.array(steps()), mixed / PRIME, side="left").astype(float)


def replicate_sums(df: DataFrame, key: str, value: str, row_id: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(key, weights, sums): per group and replicate the drawn rows and the sum of their values; row ids must be unique."""
    digest = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"|{seed}")))
    half = lambda start: F.conv(F.substring(digest, start, 7), 16, 10).cast("bigint")
    rows = df.select(F.col(key).alias("key"), known(value).cast("double").alias("value"), half(1).alias("high"), half(8).alias("low")).dropna()
    multipliers = _multipliers(replicates, seed)
    most = max(1, CELLS // replicates)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                keys = part.column("key").dictionary_encode()
                place = keys.indices.to_numpy()
                drawn = _counts(part.column("high").to_numpy(), part.column("low").to_numpy(), multipliers)
                values = part.column("value").to_numpy()
                order = np.argsort(place, kind="stable")
                firsts = np.flatnonzero(np.diff(place[order], prepend=-1))
                weights = np.add.reduceat(drawn[order], firsts)
                sums = np.add.reduceat((drawn * values[:, None])[order], firsts)
                for name, w, s in zip(keys.dictionary.take(pa.array(place[order][firsts])).to_pylist(), weights, sums):
                    held[name] = held[name] + np.stack([w, s]) if name in held else np.stack([w, s])
                if len(held) > most:
                    yield _rows(held)
                    held = {}
        if held:
            yield _rows(held)

    def merge(table: pa.Table) -> pa.Table:
        total = {}
        for part in ("weights", "sums"):
            total[part] = sum(row.values.to_numpy() for row in table.column(part))
        key_ = table.column("key")[0].as_py()
        return pa.Table.from_batches([_rows({key_: np.stack([total["weights"], total["sums"]])}, table.column("node")[0].as_py())])

    total = rows.mapInArrow(partial, SUMS)
    for nodes in (NODES, 1):
        total = total.withColumn("node", F.col("node") % nodes).groupBy("key", "node").applyInArrow(merge, SUMS)
    return total.drop("node")


def _rows(held: dict[str, np.ndarray], node: int | None = None) -> pa.RecordBatch:
    node = TaskContext.get().partitionId() if node is None else node
    lists = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array([node] * len(held), pa.int32()), pa.array(list(held), pa.string()),
         pa.array([v[0] for v in held.values()], lists), pa.array([v[1] for v in held.values()], lists)],
        ["node", "key", "weights", "sums"],
    )


def bootstrap_line_table(
    df: DataFrame, x: str, y: str, hue: str, row_id: str, level: float = 0.95, replicates: int = REPLICATES, seed: int = 42,
) -> DataFrame:
    """Mean of y per x and hue with its bootstrap percentile interval (ci_low, ci_high).

    Rows without x, hue or a known y take no part. A replicate that draws no row of a group gives no mean; a group that no
    replicate draws has a null interval. Quantiles interpolate between neighbours.
    """
    rows = df.select(x, hue, known(y).alias("_v"), F.col(row_id).alias("_id")).dropna(subset=[x, hue, "_v"])
    key = F.to_json(F.struct(x, hue))
    drawn = replicate_sums(rows.withColumn("_key", key), "_key", "_v", "_id", replicates, seed)
    means = F.filter(F.zip_with("sums", "weights", lambda s, w: F.try_divide(s, w)), lambda m: m.isNotNull())
    sorted_ = drawn.select(F.col("key").alias("_key"), F.array_sort(means).alias("_m"))

    def quantile(q: float):
        at = (F.size("_m") - 1) * F.lit(q)
        low = F.floor(at).cast("int")
        first, second = F.get("_m", low), F.get("_m", F.least(low + 1, F.size("_m") - 1))
        return first + (second - first) * (at - low)

    tail = (1 - level) / 2
    ends = sorted_.select("_key", quantile(tail).alias("ci_low"), quantile(1 - tail).alias("ci_high"))
    base = rows.groupBy(x, hue).agg(F.avg("_v").alias("mean"), F.count("_v").alias("count")).withColumn("_key", key)
    return base.join(ends, "_key", "left").select(x, hue, "mean", "count", "ci_low", "ci_high")
