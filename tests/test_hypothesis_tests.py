import math

import pytest
from pyspark.sql import functions as F

from threadtide.functions import tails
from threadtide.operators import hypothesis


def test_tails_against_tables():
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(-2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(0.0, 5) == 1.0
    assert tails.f_upper(3.098391, 3, 20) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert tails.chi2_upper(200.0, 3) == pytest.approx(0.0, abs=1e-30)
    # F with one degree equals t squared
    assert tails.f_upper(1.7 ** 2, 1, 13) == pytest.approx(tails.t_two_sided(1.7, 13), rel=1e-12)


def test_anova_of_recorded_groups(spark):
    """Recorded (n, mean, std) of comment score by period, merged over events."""
    groups = [
        ("During", 613, 109.833605, 298.366268), ("During", 586, 36.776451, 72.449661), ("During", 705, 77.714894, 181.314321),
        ("During", 703, 77.928876, 181.482446), ("After", 10, 50.2, 15.404184), ("After", 11, 3.090909, 2.256304), ("Outside", 8, 67.625, 51.933852),
    ]
    df = spark.createDataFrame(groups, "g string, n bigint, m double, s double")
    total = F.sum("n")
    mean = F.sum(F.col("n") * F.col("m")) / total
    merged = df.groupBy("g").agg(total.alias("n"), mean.alias("mean"), F.sum((F.col("n") - 1) * F.col("s") ** 2).alias("w"),
                                 (F.sum(F.col("n") * F.col("m") ** 2) - total * mean * mean).alias("b"))
    stats = merged.select("g", "n", "mean", ((F.col("w") + F.col("b")) / (F.col("n") - 1)).alias("var"))
    row = hypothesis.anova_of_statistics(stats, "g", "v").first()
    assert row["f_statistic"] == pytest.approx(0.6723, abs=5e-4)
    assert row["p_value"] == pytest.approx(0.511, abs=1e-3)
    assert (row["df_between"], row["df_within"]) == (2, 2633)


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, h string, v double")


def test_t_test_statuses(spark):
    df = frame(spark, [("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 4.0), ("b", "y", 7.0), ("c", "x", 1.0), ("d", "x", None), ("e", "x", 3.0), ("e", "y", 3.0), ("f", "y", 3.0), ("f", "y", 3.0), ("a", "x", math.nan)])
    run = lambda *a: hypothesis.t_test(df, *a).first()
    done = run("g", "v", "a", "b")
    e = 0.5 / 2 + 4.5 / 2
    assert done["status"] == "completed" and done["t_statistic"] == pytest.approx((1.5 - 5.5) / math.sqrt(e))
    assert done["df"] == pytest.approx(e ** 2 / ((0.25) ** 2 + (2.25) ** 2))
    assert "p=" in done["interpretation"]
    assert run("g", "v", "a", "d")["status"] == "skipped"
    assert run("g", "v", "a", "c")["reason"] == "A group has fewer than 2 values."
    assert run("nope", "v", "a", "b")["status"] == "error"
    assert run("g", "h", "a", "b")["reason"] == "Column 'h' is not numeric."
    flat = run("g", "v", "e", "f")
    assert flat["status"] == "completed" and flat["t_statistic"] is None and flat["p_value"] is None


def test_anova_and_chi2_statuses(spark):
    df = frame(spark, [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 4.0), ("b", None, 7.0), ("c", "x", None)])
    assert hypothesis.anova(df, "g", "v").first()["df_between"] == 1
    assert hypothesis.anova(df.where("g = 'a'"), "g", "v").first()["status"] == "skipped"
    assert hypothesis.anova(df, "g", "h").first()["status"] == "error"
    assert hypothesis.chi2_test(df.where("h = 'x'"), "g", "h").first()["reason"] == "The table is smaller than 2x2."
    assert hypothesis.chi2_test(df.where("h is null"), "g", "h").first()["reason"] == "No rows with both columns."
    assert hypothesis.chi2_test(df, "g", "zz").first()["status"] == "error"


def test_chi2_by_hand(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5}
    rows = [(g, h, 0.0) for (g, h), n in cells.items() for _ in range(n)]
    row = hypothesis.chi2_test(frame(spark, rows), "g", "h").first()
    total = sum(cells.values())
    want = 0.0
    for (g, h), n in cells.items():
        e = sum(v for (a, _), v in cells.items() if a == g) * sum(v for (_, b), v in cells.items() if b == h) / total
        want += max(abs(n - e) - 0.5, 0) ** 2 / e
    assert row["chi2_statistic"] == pytest.approx(want) and row["dof"] == 1
    assert row["p_value"] < 0.05 and "significantly associated" in row["interpretation"]
