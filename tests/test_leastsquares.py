"""Least squares with dependent columns against the pseudo-inverse."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from threadtide.operators import leastsquares, models


def _design(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.1] + [0.0, 1000.0, 5.0]
    level = np.eye(4)[rng.integers(0, 4, n)]
    # a sum of two columns, a constant and all levels of a category depend on the rest
    rows = np.column_stack([x, x[:, 0] + x[:, 2], np.full(n, 1e6), level])
    y = x @ [2.0, -0.3, 7.0] + level @ [1.0, 2.0, 3.0, 4.0] + 10 + rng.normal(size=n) * 0.1
    return rows, y


def _frame(spark, rows, y, sparse=False):
    vector = (lambda r: Vectors.sparse(len(r), [(i, float(v)) for i, v in enumerate(r) if v])) if sparse else (lambda r: Vectors.dense(r))
    data = [(i, float(v), i % 5, i % 7 == 0, vector(r)) for i, (r, v) in enumerate(zip(rows.tolist(), y))]
    return spark.createDataFrame(data, ["id", "y", "fold", "is_test", "features"]).repartition(6)


def _shortest(rows, y):
    a = rows - rows.mean(0)
    a[:, np.abs(a).max(0) < 1e-6] = 0
    slopes = np.linalg.pinv(a, rcond=1e-9) @ (y - y.mean())
    return slopes, y.mean() - rows.mean(0) @ slopes


@pytest.mark.parametrize("sparse", [False, True])
def test_equals_pseudo_inverse(spark, sparse):
    rows, y = _design()
    model = leastsquares.LeastSquares(labelCol="y").fit(_frame(spark, rows, y, sparse))
    slopes, intercept = _shortest(rows, y)
    assert np.allclose(model.coefficients, slopes, atol=1e-7) and abs(model.intercept - intercept) < 1e-4
    assert model.rank == 6
    got = model.transform(_frame(spark, rows, y, sparse)).orderBy("id").toPandas()["prediction"]
    assert np.allclose(got, rows @ slopes + intercept, atol=1e-6)


def test_fewer_rows_than_columns_and_odd_labels(spark):
    rows, y = _design(6)
    df = _frame(spark, rows, y)
    odd = df.limit(1).withColumn("y", F.lit(None).cast("double")).unionByName(df.limit(1).withColumn("y", F.lit(float("nan"))))
    model = leastsquares.LeastSquares(labelCol="y").fit(df.unionByName(odd))
    slopes, intercept = _shortest(rows, y)
    assert np.allclose(model.transform(df).orderBy("id").toPandas()["prediction"], y, atol=1e-6)
    assert np.allclose(model.coefficients, slopes, atol=1e-6)
    with pytest.raises(ValueError):
        leastsquares.LeastSquares(labelCol="y").fit(odd)
    with pytest.raises(ValueError):
        leastsquares.LeastSquares(labelCol="y").fit(df.where("false"))


def test_one_row_and_no_spread(spark):
    df = _frame(spark, np.array([[3.0, 4.0]]), [5.0])
    model = leastsquares.LeastSquares(labelCol="y").fit(df)
    assert model.rank == 0 and model.coefficients.tolist() == [0.0, 0.0] and model.intercept == pytest.approx(5.0)


def test_fold_fits_equal_single_fits(spark):
    rows, y = _design()
    df = _frame(spark, rows, y).persist()
    fits = leastsquares.fold_fits(df, "y", "fold", "is_test")
    for k in [0, 1, 2, 3, 4, None]:
        mine = df.where(~F.col("is_test")) if k is None else df.where(F.col("fold") != k)
        one = leastsquares.LeastSquares(labelCol="y").fit(mine)
        assert fits[k]["n"] == mine.count() and fits[k]["rank"] == one.rank
        assert np.allclose(fits[k]["coefficients"], one.coefficients, atol=1e-8)
    df.unpersist()


def test_narrow_tree_gives_the_same(spark, monkeypatch):
    rows, y = _design()
    df = _frame(spark, rows, y)
    one = leastsquares.LeastSquares(labelCol="y").fit(df)
    monkeypatch.setattr(leastsquares, "MERGE_BYTES", 1)
    monkeypatch.setattr(leastsquares, "PARTITIONS", 8)
    two = leastsquares.LeastSquares(labelCol="y").fit(df)
    assert np.allclose(one.coefficients, two.coefficients, atol=1e-8)


def test_saved_with_its_pipeline(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 13).alias("x"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    rows = rows.withColumn("y", 3 * F.col("x") + F.when(F.col("c") == "c1", 5).otherwise(0))
    model = models.fit_with_features(leastsquares.LeastSquares(labelCol="y"), numeric=["x"], categorical=["c"])(rows)
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert isinstance(again, PipelineModel)
    got = models.regression_metrics(again.transform(rows), "y").first()
    assert got["n"] == 200 and got["mse"] < 1e-12
