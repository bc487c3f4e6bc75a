import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threadtide.functions.text import STOP_WORDS
from threadtide.operators import attribution, boosting, features, models, splits
from threadtide.operators.tfidf import tfidf, vocabulary


def test_split_is_exact_and_stable(spark):
    for n in (1, 7, 2636):
        df = spark.range(n)
        got = splits.split_flag(df, "id")
        assert got.where("is_test").count() == math.ceil(0.2 * n)
    again = splits.split_flag(spark.range(0, 2636, 1, 3), "id")
    assert {r["id"] for r in got.where("is_test").collect()} == {r["id"] for r in again.where("is_test").collect()}
    assert splits.split_flag(spark.range(0), "id").count() == 0


def test_fold_sizes(spark):
    df = splits.with_fold(spark.range(2636).withColumn("k", F.col("id") % 3), ["k", "id"], 5)
    rows = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    assert rows == {0: 528, 1: 527, 2: 527, 3: 527, 4: 527}
    assert splits.fold_starts(2636, 5) == [528, 1055, 1582, 2109]
    assert sorted(r["fold"] for r in splits.with_fold(spark.range(3), ["id"], 5).collect()) == [0, 1, 2]


def test_positions_with_nulls_and_text(spark):
    rows = [(None, 1), ("b", 2), ("a", 3), ("a", 1), (None, 0)]
    df = splits.with_position(spark.createDataFrame(rows, "s string, i int"), ["s", "i"], partitions=3)
    got = [(r["s"], r["i"]) for r in df.orderBy("position").collect()]
    assert got == [(None, 0), (None, 1), ("a", 1), ("a", 3), ("b", 2)]
    assert sorted(r["position"] for r in df.collect()) == [0, 1, 2, 3, 4]


def test_tfidf_by_hand(spark):
    texts = ["cat dog cat", "dog bird", "the cat", "x of", None, "bird dog cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf(df, "id", "text", min_df=2, max_df=0.9).collect()}
    idf = lambda d: math.log(7 / (1 + d)) + 1
    w = {"cat": 2 * idf(3), "dog": idf(3), "dog cat": idf(2)}
    norm = math.sqrt(sum(v * v for v in w.values()))
    for term, v in w.items():
        assert got[0, term] == pytest.approx(v / norm)
    assert got[2, "cat"] == 1.0 and not any(i in (3, 4) for i, _ in got)
    kept = vocabulary(df, "id", "text", min_df=2, max_df=0.9, max_features=2).collect()
    assert [(r["term"], r["cf"]) for r in kept] == [("cat", 4), ("dog", 3)]


def test_vocabulary_is_the_same_for_any_number_of_buckets(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = ["all " + " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=rng.randint(0, 30))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    cf, rows = {}, {}
    for i, text in enumerate(texts):
        kept = [w for w in text.split() if len(w) > 1 and w not in STOP_WORDS]
        for term in [*kept, *map(" ".join, zip(kept, kept[1:]))]:
            cf[term] = cf.get(term, 0) + 1
            rows.setdefault(term, set()).add(i)
    distinct = {t: len(r) for t, r in rows.items()}
    for buckets, wanted, pairs in ((1 << 20, 40, 0), (4096, 8, 0), (600, 40, 0), (64, 40, 0), (2048, 5000, 0), (64, 40, 10**6)):
        got = vocabulary(df, "id", "text", min_df=3, max_df=0.8, max_features=wanted, buckets=buckets, plain=pairs).collect()
        eligible = [t for t in cf if distinct[t] >= 3 and distinct[t] <= 0.8 * 150]
        assert [(r["term"], r["cf"]) for r in got] == [(t, cf[t]) for t in sorted(eligible, key=lambda t: (-cf[t], t))[:wanted]]
    assert vocabulary(df.limit(0), "id", "text").count() == 0


def test_feature_text_block_matches_long_form(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ant bee cow dog the eel of fox".split()) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model = features.fit_features(df, text="text", min_df=5, max_df=0.8)
    names = features.feature_names(spark, model)
    wide = model.transform(df).select("id", F.posexplode(vector_to_array("features")).alias("slot", "w")).where("w <> 0").join(names, "slot")
    got = {(r["id"], r["name"][6:]): r["w"] for r in wide.collect()}
    want = {(r["id"], r["term"]): r["weight"] for r in tfidf(df, "id", "text").collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_one_hot_of_unseen_and_null(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    model = features.fit_features(train, categorical=["c"])
    assert model.names == ["cat__c_a", "cat__c_b", f"cat__c_{features.NULL_CATEGORY}"]
    test = spark.createDataFrame([("b",), (None,), ("new",)], "c string")
    got = [list(r["v"]) for r in model.transform(test).select(vector_to_array("features").alias("v")).collect()]
    assert got == [[0, 1, 0], [0, 0, 1], [0, 0, 0]]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, k double")
    model = features.fit_features(df, numeric=["x", "k"])
    got = [list(r["v"]) for r in model.transform(df).select(vector_to_array("features").alias("v")).collect()]
    assert got == [[-1, 0], [1, 0], [0, 0]]


def test_linear_recovers_noise_free_data(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.random(), rng.choice("ab"), rng.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame([(x, c, b, 3 * x + (2 if c == "a" else 0) - (1 if b else 0)) for x, c, b in rows], "x double, c string, b boolean, y double")
    fit = models.fit_with_features(models.linear_regression("y"), numeric=["x"], categorical=["c"], boolean=["b"])
    model = fit(df)
    assert models.regression_metrics(model.transform(df), "y").first()["r2"] == pytest.approx(1.0)
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert [r["prediction"] for r in again.transform(df).collect()] == [r["prediction"] for r in model.transform(df).collect()]
    scores = models.cross_validate(df.withColumn("fold", (F.col("x") * 3).cast("int")), fit, "y")
    assert scores.count() == 3 and scores.where("r2 < 0.999").count() == 0


def test_metrics_of_a_constant_label(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, prediction double")
    row = models.regression_metrics(df, "y").first()
    assert (row["n"], row["mse"], row["r2"]) == (2, 0.5, None)


def test_drawn_parameters(spark):
    drawn = models.draw_params(50)
    assert drawn == models.draw_params(50) and len({d["maxIter"] for d in drawn}) > 30
    assert all(3 <= d["maxDepth"] < 10 and 0.6 <= d["subsamplingRate"] <= 1 for d in drawn)


def brute_force(nodes, weights, x):
    """Shapley values by all subsets, with path-dependent expectations."""
    trees = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n

    def expect(tree, at, known):
        n = tree[at]
        if n["leftChild"] < 0:
            return n["prediction"]
        s = n["split"]
        f, vals = s["featureIndex"], s["leftCategoriesOrThreshold"]
        left = x[f] <= vals[0] if s["numCategories"] < 0 else x[f] in vals
        if f in known:
            return expect(tree, n["leftChild"] if left else n["rightChild"], known)
        l, r = tree[n["leftChild"]], tree[n["rightChild"]]
        return (l["rawCount"] * expect(tree, l["id"], known) + r["rawCount"] * expect(tree, r["id"], known)) / n["rawCount"]

    m = len(x)
    value = lambda known: sum(w * expect(t, 0, known) for (_, t), w in zip(sorted(trees.items()), weights))
    phi = []
    for f in range(m):
        rest = [i for i in range(m) if i != f]
        total = 0.0
        for k in range(m):
            for s in itertools.combinations(rest, k):
                total += math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (value({*s, f}) - value(set(s)))
        phi.append(total)
    return phi, value(set())


def test_tree_attribution_matches_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.random(), rng.random(), float(rng.randint(0, 1)), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(*r, r[1] * r[2] * 4 + (r[3] * 2 if r[4] > 0.5 else 0) + r[1]) for r in rows], "id int, a double, b double, c double, d double, y double")
    vec = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)
    model = models.boosted_trees("y", maxIter=4, maxDepth=4).fit(vec)
    nodes = [n.asDict(recursive=True) for n in attribution.tree_nodes(spark, model).collect()]
    probe = vec.where("id < 8")
    out, base = attribution.tree_attribution(probe, model, "id")
    got = {(r["id"], r["slot"]): r["shap"] for r in out.collect()}
    for r in model.transform(probe).collect():
        phi, mean = brute_force(nodes, model.treeWeights, list(r["features"].toArray()))
        assert base == pytest.approx(mean)
        for slot, want in enumerate(phi):
            assert got.get((r["id"], slot), 0.0) == pytest.approx(want, abs=1e-9)
        assert base + sum(v for (i, _), v in got.items() if i == r["id"]) == pytest.approx(r["prediction"])
    effect = attribution.global_effect(out)
    assert effect.count() == len({s for _, s in got})
    assert np.isfinite([r["mean_abs_shap"] for r in effect.collect()]).all()


def test_stump_without_splits(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0)], "id int, a double, y double")
    vec = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    model = models.boosted_trees("y", maxIter=1, maxDepth=2).fit(vec)
    out, base = attribution.tree_attribution(vec, model, "id")
    assert out.count() == 0 and base == pytest.approx(2.0)


def test_partial_sums_match_the_long_form(spark):
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 9) / 3, rng.random(), 1.0, float(rng.random() < 0.2)) for i in range(400)]
    df = spark.createDataFrame([(*r, r[1] * r[2] - 3 * r[4]) for r in rows], "id int, a double, b double, c double, d double, y double")
    vec = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).repartition(7)
    second = boosting.fit(vec, "y", "id", boosting.BoostParams(trees=12, depth=4))
    for model in (second, models.boosted_trees("y", maxIter=3, maxDepth=3).fit(vec)):
        long, base = attribution.tree_attribution(vec, model, "id")
        want = {r["slot"]: r for r in attribution.global_effect(long).collect()}
        got = {r["slot"]: r for r in attribution.tree_effect(vec, model).collect()}
        assert set(got) == set(want) and len(got) == 3
        for slot, r in got.items():
            assert r["mean_abs_shap"] == pytest.approx(want[slot]["mean_abs_shap"])
            assert (r["direction"], r["n"]) == (want[slot]["direction"], 400)
        slots = sorted(got)[:2]
        key = lambda r: (r["slot"], r["bin"])
        pairs = zip(*(sorted(d.collect(), key=key) for d in (attribution.dependence(long, slots, 7), attribution.tree_dependence(vec, model, slots, 7))), strict=True)
        for a, b in pairs:
            assert key(a) == key(b) and a["n"] == b["n"]
            assert (b["mean_value"], b["mean_shap"]) == (pytest.approx(a["mean_value"]), pytest.approx(a["mean_shap"]))
        sums = attribution.tree_sums(vec, model, "id").join(model.transform(vec), "id").collect()
        assert len(sums) == 400 and all(r["base"] == pytest.approx(base) and r["base"] + r["shap"] == pytest.approx(r["prediction"]) for r in sums)


def test_second_order_attribution_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.random(), rng.randint(0, 1) * 1.0, rng.random()) for i in range(200)]
    df = spark.createDataFrame([(*r, r[1] * r[3] * 4 + r[2]) for r in rows], "id int, a double, b double, c double, y double")
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = boosting.fit(vec, "y", "id", boosting.BoostParams(trees=3, depth=3))
    nodes = [
        {"treeID": n["tree"], "id": n["node"], "leftChild": n["left"] if n["slot"] >= 0 else -1, "rightChild": n["right"], "prediction": n["value"], "rawCount": n["cover"],
         "split": {"featureIndex": n["slot"], "numCategories": -1, "leftCategoriesOrThreshold": [n["threshold"]]}}
        for n in model.nodes()
    ]
    probe = vec.where("id < 6")
    out, base = attribution.tree_attribution(probe, model, "id")
    got = {(r["id"], r["slot"]): r["shap"] for r in out.collect()}
    for r in probe.collect():
        phi, mean = brute_force(nodes, [1.0] * 3, list(r["features"].toArray()))
        assert base == pytest.approx(model.base + mean)
        assert [got.get((r["id"], s), 0.0) for s in range(3)] == pytest.approx(phi)


def test_partial_sums_without_rows_or_splits(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 2.0)], "id int, a double, y double")
    vec = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    flat = boosting.fit(vec, "y", "id", boosting.BoostParams(trees=1))
    assert attribution.tree_effect(vec, flat).count() == attribution.tree_dependence(vec, flat, [0]).count() == 0
    assert [(r["base"], r["shap"]) for r in attribution.tree_sums(vec, flat, "id").collect()] == [(2.0, 0.0)] * 2
    split = boosting.fit(vec.withColumn("y", F.col("a")), "y", "id", boosting.BoostParams(trees=1))
    none = vec.where("id > 9")
    assert attribution.tree_effect(none, split).count() == attribution.tree_dependence(none, split, [0]).count() == 0
    one = attribution.tree_effect(vec.where("id = 1"), split).first()
    assert (one["n"], one["direction"]) == (1, None)


def test_vocabulary_keeps_no_row_id(spark, monkeypatch):
    from threadtide.operators import tfidf

    seen, plain = [], tfidf._vocabulary
    monkeypatch.setattr(tfidf, "_vocabulary", lambda df, counts, *a: seen.append(counts.columns) or plain(df, counts, *a))
    rows = spark.createDataFrame([(f"word other word{i % 2}",) for i in range(10)], "t string")
    found = tfidf.vocabulary(rows, "t", "t", max_df=1.0)  # the text as its own id, as the feature block has it
    assert seen == [["term", "tf"]] and {r["term"]: r["cf"] for r in found.collect()}["word0"] == 5


def test_tfidf_keeps_no_row_for_every_term(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    kept, plain = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda df, *a: kept.append(df.columns) or plain(df, *a))
    texts = ["Ünder_score  naïve, x2 naïve\u00a0x2!", "naïve x2 ", " naïve", "", None, "the a b", "日本 naïve\tx2 日本"]
    ids = [1, 2, 2, 3, 4, 5, None]  # two rows of one id share a norm
    df = spark.createDataFrame(list(zip(ids, texts)), "id int, text string")
    got = sorted(((r["id"] or 0, r["term"], r["weight"]) for r in tfidf(df, "id", "text", min_df=2, max_df=0.9).collect()))
    idf = lambda d: math.log(8 / (1 + d)) + 1
    n, x, nx = idf(4), idf(3), idf(3)
    rows = {0: [("naïve", n), ("naïve x2", nx), ("x2", x)], 1: [("naïve", 2 * n), ("naïve x2", 2 * nx), ("x2", 2 * x)], 2: [("naïve", n), ("naïve", n), ("naïve x2", nx), ("x2", x)]}
    want = [(i, t, w / math.sqrt(sum(v * v for _, v in r))) for i, r in rows.items() for t, w in r]
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[2] == pytest.approx(w[2]) for g, w in zip(got, want))
    assert all("term" not in c for c in kept)


def test_words_of_a_sliced_array():
    import pyarrow as pa

    from threadtide.operators import tfidf as module

    found = module.words(pa.array(["cut off", " dog the cat ", "", "ox a dog", ""]).slice(1), ["the"])
    assert [(found.distinct.to_pylist()[c], r) for c, r in zip(found.codes, found.rows)] == [("dog", 0), ("cat", 0), ("ox", 2), ("dog", 2)]
    first, second, rows = found.grams()
    assert found.spelled(first, second).to_pylist() == ["dog", "cat", "ox", "dog", "dog cat", "ox dog"] and list(rows) == [0, 0, 2, 2, 0, 2]
    assert len(module.words(pa.array(["", " "])).codes) == len(module.words(pa.array([], pa.string())).codes) == 0
