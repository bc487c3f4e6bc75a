"""Hypothesis tests: Spark reduces to group statistics, the driver evaluates one tail per test."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from threadtide.functions import tails
from threadtide.functions.numeric import known
from threadtide.operators import bounded
from threadtide.operators.grid import densify
from threadtide.operators.selection import input_problem, two_groups

ALPHA = 0.05
T_TEST = "status string, reason string, t_statistic double, df double, p_value double, group1_mean double, group2_mean double, interpretation string"
ANOVA = "status string, reason string, f_statistic double, df_between bigint, df_within bigint, p_value double, interpretation string"
CHI2 = "status string, reason string, chi2_statistic double, p_value double, dof bigint, interpretation string"


def _row(like: DataFrame, schema: str, **values: Any) -> DataFrame:
    """One result row; what the test did not produce is null."""
    fields = T.StructType.fromDDL(schema).fields
    return like.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])


def _verdict(p: float | None, significant: str, otherwise: str) -> str:
    if p is None:
        return "The statistic is undefined for these data."
    return (significant if p < ALPHA else otherwise).format(p=f"p={p:.3f}")


def t_test(df: DataFrame, group: str, value: str, first: Any, second: Any) -> DataFrame:
    """Welch's t-test of two named groups as one result row."""
    problem = input_problem(df, [group], [value])
    if problem:
        return _row(df, T_TEST, status="error", reason=problem)
    s = two_groups(df.withColumn(value, known(value)), group, value, first, second).first()
    if not s.n1 or not s.n2:
        return _row(df, T_TEST, status="skipped", reason="A group has no values.")
    if s.n1 < 2 or s.n2 < 2:
        return _row(df, T_TEST, status="skipped", reason="A group has fewer than 2 values.")
    e1, e2 = s.var1 / s.n1, s.var2 / s.n2
    t = dof = p = None
    if e1 + e2 > 0:
        t = (s.mean1 - s.mean2) / math.sqrt(e1 + e2)
        dof = (e1 + e2) ** 2 / (e1 ** 2 / (s.n1 - 1) + e2 ** 2 / (s.n2 - 1))
        p = tails.t_two_sided(t, dof)
    means = f"{first} (mean {s.mean1:.2f}) and {second} (mean {s.mean2:.2f})"
    text = _verdict(
        p,
        f"{value} differs significantly ({{p}}) between {means}.",
        f"{value} does not differ significantly ({{p}}) between {means}.",
    )
    return _row(
        df, T_TEST, status="completed", t_statistic=t, df=dof, p_value=p,
        group1_mean=s.mean1, group2_mean=s.mean2, interpretation=text,
    )


def group_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean and sample variance per non-null group."""
    return (
        df.select(F.col(group), known(value).alias("_v")).dropna()
        .groupBy(group)
        .agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.coalesce(F.var_samp("_v"), F.lit(0.0)).alias("var"))
    )


def anova_sums(stats: DataFrame) -> DataFrame:
    """Groups, rows, and sums of squares between and within from (n, mean, var) rows."""
    grand = stats.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m")).scalar()
    return stats.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.pow(F.col("mean") - grand, F.lit(2.0))).alias("ssb"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ssw"),
    )


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA over all non-null groups with values as one result row."""
    problem = input_problem(df, [group], [value])
    if problem:
        return _row(df, ANOVA, status="error", reason=problem)
    return anova_of_statistics(group_statistics(df, group, value), group, value)


def anova_of_statistics(stats: DataFrame, group: str, value: str) -> DataFrame:
    stats, _ = bounded.materialize_small(stats)
    s = anova_sums(stats).first()
    if s.k < 2:
        return _row(stats, ANOVA, status="skipped", reason="Fewer than two groups with values.")
    between, within = s.k - 1, s.total - s.k
    f = p = None
    if within > 0 and s.ssw > 0:
        f = (s.ssb / between) / (s.ssw / within)
        p = tails.f_upper(f, between, within)
    text = _verdict(
        p,
        f"{value} differs significantly ({{p}}) across at least two groups of {group}.",
        f"{value} does not differ significantly ({{p}}) across the groups of {group}.",
    )
    return _row(
        stats, ANOVA, status="completed", f_statistic=f, df_between=between, df_within=within,
        p_value=p, interpretation=text,
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts of every (a, b) cell, rows with a null dropped."""
    return _expected(observed_cells(df, a, b), a, b)


def observed_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, count) of the pairs that occur, kept as a local relation where they are few."""
    return bounded.materialize_small(df.dropna(subset=[a, b]).groupBy(a, b).count())[0]


def _expected(cells: DataFrame, a: str, b: str) -> DataFrame:
    dense = densify(cells, {a: None, b: None}).select(a, b, F.coalesce("count", F.lit(0)).alias("observed"))
    rows = cells.groupBy(a).agg(F.sum("count").alias("_ra"))
    cols = cells.groupBy(b).agg(F.sum("count").alias("_cb"))
    total = cells.agg(F.sum("count")).scalar()
    return (
        dense.join(rows, a).join(cols, b)
        .select(a, b, "observed", (F.col("_ra").cast("double") * F.col("_cb") / total).alias("expected"))
    )


def chi2_sums(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Sizes and the plain statistic from the observed cells (a, b, count) alone.

    With expected counts r * c / n the statistic is n * (sum of o**2 / (r * c) - 1), to which empty
    cells add nothing, so the grid of all pairs is never made.
    """
    rows = cells.groupBy(a).agg(F.sum("count").cast("double").alias("_ra"))
    cols = cells.groupBy(b).agg(F.sum("count").cast("double").alias("_cb"))
    total = cells.agg(F.sum("count")).scalar()
    part = F.col("count") * F.col("count") / (F.col("_ra") * F.col("_cb"))
    return cells.join(rows, a).join(cols, b).agg(
        F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"), (total * (F.sum(part) - 1)).alias("plain")
    )


def yates_statistic(cells: DataFrame, a: str, b: str) -> float:
    """Continuity-corrected statistic of a 2x2 table."""
    gap = F.abs(F.col("observed") - F.col("expected"))
    one = F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)) / F.col("expected")
    return _expected(cells, a, b).agg(F.sum(one).alias("yates")).first().yates


def chi2_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two columns as one result row; 2x2 tables get the Yates correction."""
    problem = input_problem(df, [a, b])
    if problem:
        return _row(df, CHI2, status="error", reason=problem)
    cells = observed_cells(df, a, b)
    s = chi2_sums(cells, a, b).first()
    if not s.n_a:
        return _row(df, CHI2, status="skipped", reason="No rows with both columns.")
    if s.n_a < 2 or s.n_b < 2:
        return _row(df, CHI2, status="skipped", reason="The table is smaller than 2x2.")
    dof = (s.n_a - 1) * (s.n_b - 1)
    chi2 = yates_statistic(cells, a, b) if dof == 1 else s.plain
    p = tails.chi2_upper(chi2, dof)
    text = _verdict(
        p,
        f"{a} and {b} are significantly associated ({{p}}): not independent.",
        f"{a} and {b} are not significantly associated ({{p}}): no sign against independence.",
    )
    return _row(df, CHI2, status="completed", chi2_statistic=chi2, p_value=p, dof=dof, interpretation=text)


STATISTIC = {"t_test": "t_statistic", "anova": "f_statistic", "chi2": "chi2_statistic"}


def battery(df: DataFrame, specs: Sequence[tuple]) -> DataFrame:
    """Several tests as rows (test, columns, status, statistic, p_value, interpretation).

    A spec is ("t_test", group, value, first, second), ("anova", group, value) or ("chi2", a, b).
    """
    tests = {"t_test": t_test, "anova": anova, "chi2": chi2_test}
    out = None
    for i, (kind, *args) in enumerate(specs):
        row = tests[kind](df, *args).select(
            F.lit(i).alias("test_no"), F.lit(kind).alias("test"), F.lit(" | ".join(map(str, args))).alias("arguments"),
            "status", "reason", F.col(STATISTIC[kind]).alias("statistic"), "p_value", "interpretation",
        )
        out = row if out is None else out.unionByName(row)
    return out
