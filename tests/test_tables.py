import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_oracles import plan_of
from threadtide.functions.text import contains_word
from threadtide.operators import bounded, grid, correlation, distribution, quantiles, summary, threads
from threadtide.operators.grid import densify
from threadtide.sources.events import EventWindow, event_dimension


def sample(seed=1, n=600):
    """Mixed signs, magnitudes, repeats, a hot group and a group of one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = rng.choice([0.0, rng.gauss(0, 1), rng.uniform(-1e6, 1e6), rng.expovariate(1e3), float(rng.randint(-3, 3)), -1e-12])
        rows.append(("hot" if rng.random() < 0.7 else rng.choice("abc"), v))
    return rows + [("one", 5.0), ("gone", None), ("gone", math.nan), (None, 3.0)]


PROBS, NAMES = [0.0, 0.25, 0.5, 0.9, 1.0], ["p0", "p25", "p50", "p90", "p100"]


@pytest.mark.parametrize("options", [
    {}, {"max_group_rows": 0}, {"max_group_rows": 0, "max_local_groups": 2}, {"max_group_rows": 0, "max_bucket_rows": 3},
])
def test_quantiles_are_exact(spark, options):
    rows = sample()
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in quantiles.grouped_quantiles(df, ["g"], "v", PROBS, NAMES, **options).collect()}
    groups = {}
    for g, v in rows:
        if g is not None and v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g]["count"] == len(vs)
        assert got[g]["mean"] == pytest.approx(statistics.fmean(vs), rel=1e-9, abs=1e-9)
        assert (got[g]["min"], got[g]["max"]) == (min(vs), max(vs))
        for p, name in zip(PROBS, NAMES):
            assert got[g][name] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12, abs=1e-15)
        if len(vs) > 1:
            assert got[g]["std"] == pytest.approx(statistics.stdev(vs), rel=1e-9)
    assert got["one"]["std"] is None


def test_quantiles_of_extremes(spark):
    vs = [math.inf, -math.inf, 1.7e308, 5e-324, -5e-324, 0.0, -0.0, 2.0]
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    row = quantiles.grouped_quantiles(df.where("v < 1e307 and v > -1e307"), [], "v", [0.5], ["m"], max_group_rows=0).first()
    assert row["m"] == pytest.approx(0.0, abs=1e-300)


def test_times_in_one_bucket(spark):
    base = 1.7e9
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.lit(base) + F.col("id") * 1e-6).alias("v"))
    for limits in ({}, {"max_group_rows": 0}, {"max_group_rows": 0, "max_bucket_rows": 10}):
        row = quantiles.grouped_quantiles(df, ["g"], "v", [0.5], ["m"], **limits).first()
        assert row["m"] == pytest.approx(base + 2499.5e-6, abs=3e-7)


def test_many_groups_take_one_pass(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.col("id").cast("double").alias("v"))
    plan = plan_of(quantiles.grouped_quantiles(df, ["g"], "v", [0.5], ["m"]))
    assert "Window" not in plan and plan.count("Range (") == 1


def test_buckets_keep_order(spark):
    rng = random.Random(3)
    vs = sorted({rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(3000)} | {0.0} | {2.0 ** k for k in range(-50, 50)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v double")
    for steps in (quantiles.STEPS, quantiles.FINE_STEPS):
        got = [r["b"] for r in df.select("i", quantiles.magnitude_bucket(F.col("v"), steps).alias("b")).orderBy("i").collect()]
        assert got == sorted(got)


def test_empty_input(spark):
    df = spark.createDataFrame([], "event_name string, time_period string, v double")
    assert summary.summary_by_period_and_event(df, "v").count() == 0
    assert summary.summary_by_event(df, "v").count() == 0
    assert distribution.kde_curve(df, "v").count() == 0
    assert distribution.histogram(df, "v").count() == 0


def test_dense_summary_keeps_absent_cells_null(spark):
    df = spark.createDataFrame([("During Event", "a", 1.0), ("During Event", "a", 3.0), ("After Event", "b", 5.0)], "time_period string, event_name string, v double")
    rows = {(r["time_period"], r["event_name"]): r for r in summary.summary_by_period_and_event(df, "v").collect()}
    assert len(rows) == 8
    cell = rows["During Event", "a"]
    assert (cell["mean"], cell["median"], cell["count"]) == (2.0, 2.0, 2)
    assert cell["lower_bound"] == pytest.approx(2 - math.sqrt(2))
    assert rows["Before Event", "b"]["count"] is None and rows["Before Event", "b"]["mean"] is None
    assert rows["After Event", "b"]["std"] is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, 5.0]], "v double")
    assert [(r["bin"], r["count"]) for r in distribution.histogram(df, "v", 4).orderBy("bin").collect()] == [(0, 2), (1, 1), (2, 0), (3, 1)]
    flat = spark.createDataFrame([(7.0,), (7.0,)], "v double")
    assert [(r["bin"], r["lo"], r["count"]) for r in distribution.histogram(flat, "v", 4).collect()] == [(0, 7.0, 2)]
    assert distribution.kde_curve(flat, "v").count() == 0


def test_kde_matches_direct_sum(spark):
    rng = random.Random(5)
    vs = [rng.gauss(0, 1) for _ in range(300)] + [1e6, 1e6, -3.0]
    df = spark.createDataFrame([(v,) for v in vs], "v double").repartition(4)
    got = distribution.kde_curve(df, "v").orderBy("i").collect()
    h = len(vs) ** -0.2 * statistics.stdev(vs)
    x = np.linspace(min(vs), max(vs), 200)
    want = np.exp(-0.5 * ((x[:, None] - np.array(vs)) / h) ** 2).sum(axis=1) / (len(vs) * h * math.sqrt(2 * math.pi))
    assert [r["x"] for r in got] == pytest.approx(list(x))
    assert [r["kde_density"] for r in got] == pytest.approx(list(want), rel=1e-9, abs=1e-300)


def test_period_table_adds_up(spark):
    rows = [("a", "During Event")] * 3 + [("a", "After Event")] + [("b", "Outside Window")] + [("b", None), ("b", "Error: Invalid Timestamp Format")]
    table = {r["event_name"]: r.asDict() for r in summary.period_table(spark.createDataFrame(rows, "event_name string, time_period string")).collect()}
    assert (table["a"]["during_event"], table["a"]["during_event_pct"], table["a"]["before_event"]) == (3, 75.0, 0)
    for row in table.values():
        assert sum(v for k, v in row.items() if k.endswith("_pct")) == pytest.approx(100.0)


def test_correlation_by_definition(spark):
    rng = random.Random(7)
    rows = [(rng.random(), rng.choice([None, rng.gauss(1e6, 1)]), rng.random() < 0.5, 4.0, rng.choice([math.nan, rng.random()])) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c boolean, d double, e double")
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in correlation.correlation_pairs(df).collect()}
    assert len(got) == 10
    for (a, b), (r, n) in got.items():
        both = [(float(x), float(y)) for x, y in ((row["abcde".index(a)], row["abcde".index(b)]) for row in rows) if x is not None and y is not None and x == x and y == y]
        assert n == len(both)
        if "d" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(statistics.correlation(*zip(*both)), abs=1e-9)
    full = correlation.correlation_matrix(df)
    assert full.count() == 25


@pytest.mark.parametrize("more", [0, 12])
def test_correlation_keeps_small_spreads_at_any_number_of_pairs(spark, more):
    rows = [(1e6 + 0.25 * (-1) ** i if i % 2 or i < 50 else 0.0, (1.0 * (-1) ** i) if i < 50 else None, 1e15) + (0.5 * i,) * more for i in range(100)]
    names = ["x", "y", "flat", *[f"m{k}" for k in range(more)]]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    got = {(r["a"], r["b"]): r["r"] for r in correlation.correlation_pairs(df).collect()}
    assert got["x", "y"] == pytest.approx(1.0, abs=1e-9) and got["x", "flat"] is None


def test_small_side_is_counted(spark):
    df = spark.range(20)
    local, small = bounded.materialize_small(df, 20)
    assert small and local.count() == 20
    same, small = bounded.materialize_small(df, 19)
    assert not small and same is df


def test_grid_of_two_observed_keys(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, l string, n int")
    assert densify(df, {"k": None, "l": None}).count() == 4


def test_grid_of_many_values_and_nulls(spark, monkeypatch):
    rows = [(f"k{i % 5}", i % 7, i) for i in range(35)] + [(None, 1, 1), ("k1", None, 2)]
    df = spark.createDataFrame(rows, "k string, l int, n int").groupBy("k", "l").count()
    few = sorted(map(tuple, densify(df, {"k": None, "l": None}).collect()))
    assert len(few) == 35 and all(n == 1 for *_, n in few)
    monkeypatch.setattr(grid, "materialize_small", lambda table, *_: (table, False))
    assert sorted(map(tuple, densify(df, {"k": None, "l": None}).collect())) == few


def test_profile(spark):
    df = spark.createDataFrame([("x", 1.0, True), ("x", 2.0, None), ("a", None, None), ("a", 9.0, None)], "s string, v double, b boolean")
    rows = {r["column"]: r for r in summary.profile(df).collect()}
    assert (rows["s"]["count"], rows["s"]["unique"], rows["s"]["top"], rows["s"]["freq"]) == (4, 2, "a", 2)
    assert (rows["v"]["count"], rows["v"]["q50"], rows["v"]["max"]) == (3, 2.0, 9.0)
    assert (rows["b"]["count"], rows["b"]["mean"]) == (1, None)


# --- ranking, events, skew -------------------------------------------------------------------------

def test_dedup_and_listings(spark):
    rows = [("e1", 1, 5, "first"), ("e1", 1, 9, "second"), ("e2", 1, 9, "other event")]
    df = spark.createDataFrame(rows, "event_name string, id int, at int, what string")
    kept = threads.first_per_key(df, ["event_name", "id"], [F.asc("at")])
    assert sorted(r["what"] for r in kept.collect()) == ["first", "other event"]
    a, b = spark.createDataFrame([(1, "a"), (2, "a")], "id int, src string"), spark.createDataFrame([(2, "b")], "id int, src string")
    assert sorted(map(tuple, threads.merge_listings([a, b], ["id"]).collect())) == [(1, "a"), (2, "b")]


def test_hot_keys_are_pruned_before_the_shuffle(spark):
    """A third of all rows share one key: each map task sends at most n rows of it."""
    df = spark.range(0, 30_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    top = threads.top_n(df, ["k"], [F.desc("v")], 2)
    plan = plan_of(top)
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")
    assert sorted(r["v"] for r in top.where("k = 0").collect()) == [29994, 29997]


def test_ties_and_short_groups(spark):
    df = spark.createDataFrame([("a", 1, 7.0), ("a", 2, 7.0), ("a", 3, 7.0), ("b", 4, 1.0)], "k string, id int, s double")
    got = threads.top_n(df, ["k"], [F.desc("s"), F.asc("id")], 2)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4]


def test_event_assignment_paths_agree(spark, monkeypatch):
    day = datetime(2024, 1, 1)
    events = event_dimension(spark, [EventWindow(f"w{i}", day + timedelta(hours=5 * i), day + timedelta(hours=5 * i + 30), "aa bb" if i % 2 else "") for i in range(12)])
    rows = spark.createDataFrame([(i, day + timedelta(minutes=37 * i), "AA x bb" if i % 3 else "zz") for i in range(200)], "i int, t timestamp, txt string")
    few = sorted(map(tuple, threads.assign_events(rows, "t", events, ["txt"]).select("i", "event_name").collect()))
    monkeypatch.setattr(threads, "MAX_INLINE_EVENTS", 3)
    many = threads.assign_events(rows, "t", events, ["txt"]).select("i", "event_name")
    assert "NestedLoop" not in plan_of(many)
    assert sorted(map(tuple, many.collect())) == few and len(few) > 200
    pairs = threads.pair_with_events(rows, events)
    assert pairs.count() == 200 * 12 and pairs.columns == [*rows.columns, *events.columns]


def test_windows_of_any_length_meet_their_rows(spark, monkeypatch):
    day = datetime(2024, 1, 1)
    spans = [(0, 1), (5, 5), (10, 400_000), (59, 61), (60, 119), (7, 3), (1000, 90_000)]
    events = event_dimension(spark, [EventWindow(f"w{i}", day + timedelta(seconds=a), day + timedelta(seconds=b)) for i, (a, b) in enumerate(spans)])
    rows = spark.createDataFrame([(i, day + timedelta(seconds=i * 31)) for i in range(2000)], "i int, t timestamp")
    few = sorted(map(tuple, threads.assign_events(rows, "t", events).select("i", "event_name").collect()))
    monkeypatch.setattr(threads, "MAX_INLINE_EVENTS", 2)
    assert sorted(map(tuple, threads.assign_events(rows, "t", events).select("i", "event_name").collect())) == few
    none = threads.assign_events(rows, "t", events.limit(0))
    assert none.count() == 0 and none.columns == [*rows.columns, *events.columns]


def test_keyword_table_agrees_with_contains_word(spark):
    entries = ["call of the wild", "cr1t-", "of the", "x²", "og", "#tag", "--", "v.p", "été", "a\\eb"]
    texts = ["the call of the wild!", "call of the, wild", "of, the", "cr1t-x", "cr1t- x", "x²y", "x²", "og", "dog", "a #tag", "z#tag", "a--b", "a -- b", "V.P", "étéx", "été", "a\\eb", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = spark.createDataFrame([(e,) for e in [*entries, "", None]], "keyword string")
    got = {r["i"] for r in threads.keyword_rows(rows, "i", "t", words).collect()}
    want = {r["i"] for r in rows.where(contains_word("t", entries)).collect()}
    assert got == want and {0, 2} & got == {0}


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = plan_of(orders.where(F.col("o_totalprice") > 5).select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,5.0)]" in plan
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = plan_of(quantiles.group_moments(lines, ["l_returnflag"], "l_tax", [0.5]))
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan
