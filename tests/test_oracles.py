"""Every registered query against its SQL oracle, and the plans against scale rules."""

import pytest

import __spark_entry__ as entry
from workload import registry
from tests.compare import difference
from tests.conftest import SF_DIR

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
# Trees, their attribution, the co-moments of correlation and bootstrap replicates work on Arrow batches; nothing else leaves the JVM.
PYTHON_STEPS = {
    "l09_boosted_trees", "l13_tree_attribution", "l14_global_effect", "l14_effect_total", "l15_dependence", "l15_dependence_bins", "h08_bootstrap_interval",
    "q04_correlation", "q04_correlation_native", "q04_correlation_offset", "q04_correlation_matrix",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def check_plan(name, df):
    plan = plan_of(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan, f"{name} uses {node}"
    if name not in PYTHON_STEPS:
        for node in ("MapInPandas", "ArrowEvalPython", "FlatMapGroups"):
            assert node not in plan, f"{name} uses {node}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    check_plan(name, df)
    assert difference(df, duck, ORACLES[name]) is None
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    check_plan(name, df)
    assert df.count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["time_period", "event_name", "mean", "std", "median", "count", "lower_bound", "upper_bound"]
    assert df.count() == 8


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_leak_guard_scores_without_a_second_join(spark):
    assert "Join" not in plan_of(QUERIES["l17_leak_guard"](spark, SF_DIR))
