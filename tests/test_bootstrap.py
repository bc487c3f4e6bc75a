"""Bootstrap intervals against a plain resampling with the same counts, and against drawing with repeats."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from threadtide.operators import bootstrap


def _plain_counts(ids, replicates, seed=42):
    a, b, c = bootstrap._multipliers(replicates, seed).tolist()
    bounds, out = bootstrap.steps(), []
    for i in ids:
        d = hashlib.md5(f"{i}|{seed}".encode()).hexdigest()
        high, low = int(d[:7], 16), int(d[7:14], 16)
        out.append([sum((high * a[r] + low * b[r] + c[r]) % bootstrap.PRIME / bootstrap.PRIME > s for s in bounds) for r in range(replicates)])
    return np.array(out, dtype=float)


def _rows(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("g"), F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("x"), ((F.col("id") * 7919) % 101).cast("double").alias("v"))


def test_equals_plain_replicates(spark, monkeypatch):
    df = _rows(spark, 120).repartition(5)
    local = df.toPandas()
    for cells in (bootstrap.CELLS, 100):
        monkeypatch.setattr(bootstrap, "CELLS", cells)
        got = {(r["x"], r["g"]): r for r in bootstrap.bootstrap_line_table(df, "x", "v", "g", "id", replicates=50).collect()}
        assert len(got) == 6
        for (x, g), part in local.groupby(["x", "g"]):
            counts, v = _plain_counts(part["id"], 50), part["v"].to_numpy()
            means = (counts * v[:, None]).sum(0) / counts.sum(0)
            row = got[(x, g)]
            assert np.allclose([row["ci_low"], row["ci_high"]], np.quantile(means, [0.025, 0.975])) and row["count"] == len(v)


def test_width_is_that_of_drawing_with_repeats(spark):
    df = _rows(spark, 900)
    v = np.array([r["v"] for r in df.where("g = 'g0' AND x = 0").collect()])
    row = bootstrap.bootstrap_line_table(df, "x", "v", "g", "id").where("g = 'g0' AND x = 0").first()
    rng = np.random.default_rng(1)
    low, high = np.quantile(v[rng.integers(0, len(v), (4000, len(v)))].mean(1), [0.025, 0.975])
    assert abs((row["ci_high"] - row["ci_low"]) / (high - low) - 1) < 0.12


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, 5.0), (2, None, 1, 1.0), (3, "a", None, 1.0), (4, "a", 2, None), (5, "a", 3, float("nan"))], "id int, g string, x int, v double")
    rows = bootstrap.bootstrap_line_table(df, "x", "v", "g", "id").collect()
    assert [(r["x"], r["g"], r["count"], r["ci_low"], r["ci_high"]) for r in rows] == [(1, "a", 1, 5.0, 5.0)]
    assert bootstrap.bootstrap_line_table(df.limit(0), "x", "v", "g", "id").count() == 0
