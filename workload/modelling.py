"""TF-IDF, feature blocks, splits, models and attribution over the driver tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threadtide.functions.text import STOP_WORDS
from threadtide.operators import attribution, boosting, features, leastsquares, models, splits
from threadtide.operators.tfidf import tfidf, vocabulary
from threadtide.session import scratch_path
from threadtide.sources.tables import spread
from workload import views
from workload.features import LETTER, words_sql
from workload.registry import query
from workload.views import rounded, table

TERMS_SQL = f"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^{LETTER}]+'),
    lambda t: length(t) > 1 AND NOT list_contains({words_sql(STOP_WORDS)}, t)) AS w FROM documents),
  grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
  vocab AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term
    HAVING count(*) >= 5 AND count(*) <= 0.8 * (SELECT count(*) FROM documents) ORDER BY sum(tf) DESC, term LIMIT 5000)"""


@query("l01_tfidf_weights", f"""WITH {TERMS_SQL}, weights AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weights""")
def _(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rounded(tfidf(docs, "doc_id", "text"))


@query("l01_tfidf_vocabulary", f"WITH {TERMS_SQL} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")
def _(spark, sf_dir):
    return rounded(vocabulary(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text"))


def model_rows(spark, sf_dir):
    """Line items with their part: numbers, categories and flags for the models."""
    lines, part = spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("deep", F.col("l_discount") > 0.05)
    # line items repeat their keys, so the row id is a hash over the whole row
    return rows.withColumn("row_id", F.xxhash64(*[F.col(c) for c in lines.columns])).withColumn(
        "flag", F.nullif("l_returnflag", F.lit("N"))
    )


def _slot_sums(model, df, places: int):
    """Per vector slot its name and the sum of its squares."""
    whole = model.transform(df).select(F.posexplode(vector_to_array(model.output)).alias("slot", "x")).where("x <> 0")
    names = features.feature_names(df.sparkSession, model)
    sums = whole.groupBy("slot").agg(F.round(F.sum(F.col("x") * F.col("x")), places).alias("total"))
    return sums.join(F.broadcast(names), "slot").select("name", "total")


@query("l02_one_hot", """SELECT 'cat__flag_' || coalesce(nullif(l_returnflag, 'N'), '∅') AS name, count(*)::DOUBLE AS total FROM lineitem GROUP BY 1
UNION ALL SELECT 'cat__p_type_' || p_type, count(*)::DOUBLE FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return _slot_sums(features.fit_features(rows, categorical=["flag", "p_type"]), rows, 4)


@query("l03_standardize", """SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value, 0.0::DOUBLE AS zero FROM events""")
def _(spark, sf_dir):
    rows = views.activity(spark, sf_dir).select("event_id", "value", F.lit(0.0).alias("zero"))
    return rounded(features.standardize(rows, ["value", "zero"]))


@query("l04_boolean_block", """SELECT 'bool__deep' AS name, count(*) FILTER (l_discount > 0.05)::DOUBLE AS total FROM lineitem""")
def _(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return _slot_sums(features.fit_features(rows, boolean=["deep"]), rows, 4)


@query("l05_combined_vector", """SELECT 'cat__l_returnflag_' || l_returnflag AS name, count(*)::DOUBLE AS total FROM lineitem GROUP BY 1
UNION ALL SELECT 'num__l_quantity', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'num__l_tax', count(*)::DOUBLE FROM lineitem
UNION ALL SELECT 'bool__deep', count(*) FILTER (l_discount > 0.05)::DOUBLE FROM lineitem""")
def _(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    model = features.fit_features(rows, categorical=["l_returnflag"], numeric=["l_quantity", "l_tax"], boolean=["deep"])
    return _slot_sums(model, rows, 3)


@query("l05_text_block", f"""WITH {TERMS_SQL}, weights AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
  unit AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM weights)
SELECT 'text__' || term AS name, round(sum(u * u), 6) AS total FROM unit GROUP BY term""")
def _(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _slot_sums(features.fit_features(docs, text="text"), docs, 6)


@query("l06_split", """SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '|42'), event_id) <= ceil(0.2 * (SELECT count(*) FROM events)) AS is_test FROM events""")
def _(spark, sf_dir):
    return splits.split_flag(views.activity(spark, sf_dir).select("event_id"), "event_id")


OLS_SQL = "regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem"


@query("l07_linear_regression", f"""WITH f AS (SELECT {OLS_SQL})
SELECT round(any_value(b), 4) AS slope, round(any_value(a), 4) AS intercept, count(*) AS n, round(avg((l_extendedprice - a - b * l_quantity) ** 2), 0) AS mse,
  round(1 - sum((l_extendedprice - a - b * l_quantity) ** 2) / (count(*) * var_pop(l_extendedprice)), 8) AS r2 FROM lineitem, f""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    fit = models.fit_with_features(models.linear_regression("l_extendedprice"), numeric=["l_quantity"])
    model = fit(rows)
    spread_ = features.scaling_table(rows, ["l_quantity"]).first()["l_quantity"]
    slope = float(model.stages[-1].coefficients[0]) / spread_["s"]
    intercept = model.stages[-1].intercept - slope * spread_["m"]
    got = models.regression_metrics(model.transform(rows), "l_extendedprice")
    return got.select(F.round(F.lit(slope), 4).alias("slope"), F.round(F.lit(intercept), 4).alias("intercept"), "n",
                      F.round("mse", 0).alias("mse"), F.round("r2", 8).alias("r2"))


# levels of a category and one slope in closed form: the slope within levels, then each level's own mean
FOLDS_SQL = """WITH r AS (SELECT event_type AS c, user_id AS x, value AS y, ntile(5) OVER (ORDER BY ts, event_id) - 1 AS fold,
    row_number() OVER (ORDER BY md5(event_id || '|42'), event_id) <= ceil(0.2 * (SELECT count(*) FROM events)) AS is_test FROM events),
  parts AS (SELECT 'test' AS part, c, x, y, is_test AS held FROM r
    UNION ALL SELECT 'fold ' || k, c, x, y, fold = k FROM r, (SELECT unnest(range(5)) AS k)),
  lines AS (SELECT part, c, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM parts WHERE NOT held GROUP BY ALL),
  slopes AS (SELECT part, sum(sxy) / sum(sxx) AS b FROM lines GROUP BY part),
  scored AS (SELECT part, y, my + b * (x - mx) AS p FROM parts JOIN lines USING (part, c) JOIN slopes USING (part) WHERE held)
SELECT part, count(*) AS n, round(avg((y - p) ** 2), 4) AS mse, round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 8) AS r2 FROM scored GROUP BY part"""


@query("l07_test_and_folds", FOLDS_SQL)
def _(spark, sf_dir):
    # all levels of the category and a doubled column: the columns depend on each other
    rows = views.activity(spark, sf_dir).select("event_id", "ts", "event_type", "user_id", (2 * F.col("user_id") + 3).alias("doubled"), "value")
    rows = splits.with_fold(splits.split_flag(rows, "event_id"), ["ts", "event_id"], models.CV_FOLDS)
    feats = features.fit_features(rows, categorical=["event_type"], numeric=["user_id", "doubled"])
    vectors = feats.transform(rows).select("value", "fold", "is_test", "features").persist()
    fits = leastsquares.fold_fits(vectors, "value", "fold", "is_test")
    out = None
    for k, fit in fits.items():
        held = vectors.where(F.col("is_test") if k is None else F.col("fold") == k)
        scored = held.withColumn("prediction", leastsquares.linear_prediction("features", fit["intercept"], fit["coefficients"]))
        part = models.regression_metrics(scored, "value").select(
            F.lit("test" if k is None else f"fold {k}").alias("part"), "n", F.round("mse", 4).alias("mse"), F.round("r2", 8).alias("r2")
        )
        out = part if out is None else out.unionAll(part)
    return out


@query("l08_contiguous_folds", "SELECT event_id, (ntile(5) OVER (ORDER BY ts, event_id) - 1)::INTEGER AS fold FROM events")
def _(spark, sf_dir):
    return splits.with_fold(views.activity(spark, sf_dir).select("event_id", "ts"), ["ts", "event_id"], 5).select("event_id", "fold")


PART_ROLES = {"categorical": ["p_type", "p_brand"], "numeric": ["p_partkey", "p_size"]}


def _parts(spark, sf_dir):
    """Parts with their split and folds, and their vectors by the features of the training rows."""
    rows = splits.split_flag(table(spark, sf_dir, "part"), "p_partkey")
    rows = splits.with_fold(rows, ["p_partkey"], models.SEARCH_FOLDS).persist()
    feats = features.fit_features(rows.where(~F.col("is_test")), **PART_ROLES)
    return feats, feats.transform(rows).select("p_partkey", "p_retailprice", "is_test", "fold", "features").persist()


def _second_order(spark, sf_dir):
    feats, vectors = _parts(spark, sf_dir)
    return feats, vectors, boosting.fit(vectors.where(~F.col("is_test")), "p_retailprice", "p_partkey")


@query("l09_boosted_trees", """SELECT 200 AS trees, 6 AS depth, ceil(0.2 * count(*))::BIGINT AS n_test, count(*) - ceil(0.2 * count(*))::BIGINT AS n_train, TRUE AS beats_mean FROM part""")
def _(spark, sf_dir):
    _, vectors, model = _second_order(spark, sf_dir)
    got = models.regression_metrics(model.transform(vectors.where("is_test")), "p_retailprice")
    cover = int(model.trees[0].cover[0])
    depth = max(_depth(t) for t in model.trees)
    return got.select(F.lit(len(model.trees)).alias("trees"), F.lit(depth).alias("depth"), F.col("n").alias("n_test"),
                      F.lit(cover).cast("bigint").alias("n_train"), (F.col("r2") > 0.5).alias("beats_mean"))


def _depth(tree, node=0):
    return 0 if tree.slot[node] < 0 else 1 + max(_depth(tree, tree.left[node]), _depth(tree, tree.left[node] + 1))


@query("l10_random_search")
def _(spark, sf_dir):
    feats, vectors = _parts(spark, sf_dir)
    draws = [boosting.BoostParams(**p) for p in models.draw_params(models.SEARCH_DRAWS, boosting.SPACE)]
    best, found = boosting.search(vectors.where(~F.col("is_test")), "p_retailprice", "p_partkey", draws, "fold")
    names = list(boosting.SPACE)
    params = spark.createDataFrame([(i, p == best, *[float(getattr(p, n)) for n in names]) for i, p in enumerate(draws)],
                                   "candidate int, is_best boolean, " + ", ".join(f"{n} double" for n in names))
    return params.join(found, "candidate")


@query("l11_metrics", """SELECT count(*) AS n, round(avg((l_extendedprice - 2000 * l_quantity) ** 2), 0) AS mse,
  round(1 - sum((l_extendedprice - 2000 * l_quantity) ** 2) / (count(*) * var_pop(l_extendedprice)), 6) AS r2 FROM lineitem""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("prediction", 2000 * F.col("l_quantity"))
    got = models.regression_metrics(rows, "l_extendedprice")
    return got.select("n", F.round("mse", 0).alias("mse"), F.round("r2", 6).alias("r2"))


@query("l12_feature_importance")
def _(spark, sf_dir):
    feats, _, model = _second_order(spark, sf_dir)
    rows = [(n, float(v)) for n, v in zip(feats.names, model.importance())]
    return models.top_features(spark.createDataFrame(rows, "name string, importance double"))


@query("l12_importance_total", "SELECT 1.0::DOUBLE AS total, count(DISTINCT p_type) + count(DISTINCT p_brand) + 2 AS slots FROM part")
def _(spark, sf_dir):
    feats, _, model = _second_order(spark, sf_dir)
    rows = [(n, float(v)) for n, v in zip(feats.names, model.importance())]
    return spark.createDataFrame(rows, "name string, importance double").agg(F.round(F.sum("importance"), 6).alias("total"), F.count(F.lit(1)).alias("slots"))


@query("l13_linear_attribution", f"""WITH f AS (SELECT {OLS_SQL})
SELECT l_orderkey, l_linenumber, l_suppkey, round(b * (l_quantity - avg(l_quantity) OVER ()), 3) AS shap_l_quantity FROM lineitem, f""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    line = rows.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b")).first()
    out = attribution.linear_attribution(rows, {"l_quantity": line["b"]})
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", F.round("shap_l_quantity", 3).alias("shap_l_quantity"))


TEST_PARTS = """parts AS (SELECT *, row_number() OVER (ORDER BY md5(p_partkey || '|42'), p_partkey) <= ceil(0.2 * (SELECT count(*) FROM part)) AS is_test FROM part),
  test AS (SELECT * FROM parts WHERE is_test)"""


@query("l13_tree_attribution", f"WITH {TEST_PARTS} SELECT p_partkey, TRUE AS adds_up FROM test")
def _(spark, sf_dir):
    _, vectors, model = _second_order(spark, sf_dir)
    test = model.transform(vectors.where("is_test"))
    sums = attribution.tree_sums(test, model, "p_partkey").join(test.select("p_partkey", "prediction"), "p_partkey")
    return sums.select("p_partkey", (F.abs(F.col("base") + F.col("shap") - F.col("prediction")) < 1e-6).alias("adds_up"))


@query("l14_global_effect")
def _(spark, sf_dir):
    feats, vectors, model = _second_order(spark, sf_dir)
    found = attribution.tree_effect(vectors.where("is_test"), model)
    return rounded(found.join(features.feature_names(spark, feats), "slot"), 4)


@query("l14_effect_total", f"WITH {TEST_PARTS} SELECT count(*) AS n, TRUE AS adds_up FROM test")
def _(spark, sf_dir):
    _, vectors, model = _second_order(spark, sf_dir)
    test = vectors.where("is_test")
    effect = attribution.tree_effect(test, model).agg(F.max("n").alias("n"), F.sum("mean_shap").alias("shap"))
    mean = model.transform(test).agg(F.avg("prediction")).scalar()
    base = attribution.tree_sums(test, model, "p_partkey").agg(F.max("base")).scalar()
    return effect.select("n", (F.abs(F.col("shap") + base - mean) < 1e-6).alias("adds_up"))


@query("l15_dependence")
def _(spark, sf_dir):
    feats, vectors, model = _second_order(spark, sf_dir)
    test = vectors.where("is_test")
    top = attribution.tree_effect(test, model).orderBy(F.desc("mean_abs_shap"), "slot").limit(10).select("slot").collect()
    found = attribution.tree_dependence(test, model, [r["slot"] for r in top])
    return rounded(found.join(features.feature_names(spark, feats), "slot"), 4)


@query("l15_dependence_bins", f"""WITH {TEST_PARTS},
  fitted AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM parts WHERE NOT is_test),
  ends AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM test)
SELECT least(((p_size - lo) * 20) // (hi - lo), 19)::BIGINT AS bin, round(avg((p_size - m) / s), 6) AS mean_value, count(*) AS n FROM test, fitted, ends GROUP BY 1""")
def _(spark, sf_dir):
    feats, vectors, model = _second_order(spark, sf_dir)
    found = attribution.tree_dependence(vectors.where("is_test"), model, [feats.names.index("num__p_size")])
    return found.select("bin", F.round("mean_value", 6).alias("mean_value"), "n")


@query("l16_apply_pipeline", f"""WITH f AS (SELECT {OLS_SQL})
SELECT l_orderkey, l_linenumber, l_suppkey, round(a + b * l_quantity, 2) AS prediction FROM lineitem, f""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    fit = models.fit_with_features(models.linear_regression("l_extendedprice"), numeric=["l_quantity"])
    return fit(rows).transform(rows).select("l_orderkey", "l_linenumber", "l_suppkey", F.round("prediction", 2).alias("prediction"))


@query("s10_save_model", "SELECT count(*) AS n, 0.0::DOUBLE AS largest_gap FROM lineitem")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    fit = models.fit_with_features(models.linear_regression("l_extendedprice"), numeric=["l_quantity", "l_tax"], categorical=["l_returnflag"])
    model = fit(rows)
    path = scratch_path(spark, "model")
    models.save_model(model, path)
    again = models.load_model(path)
    both = again.transform(model.transform(rows).select("l_quantity", "l_tax", "l_returnflag", F.col("prediction").alias("first")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("first") - F.col("prediction"))).alias("largest_gap"))


LEAK_SQL = """WITH t AS (SELECT l_extendedprice AS y, o_totalprice AS a, CASE WHEN l_shipdate > o_orderdate
    THEN l_extendedprice / ((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000::DOUBLE) ELSE l_extendedprice END AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  c AS (SELECT count(*) AS n, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM t)
SELECT 'with leak' AS inputs, 'comment_score_per_day' AS flagged, n, round((ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab), 4) AS r2 FROM c
UNION ALL SELECT 'without', '', n, round(ya * ya, 4) FROM c"""


@query("l17_leak_guard", LEAK_SQL)
def _(spark, sf_dir):
    from threadtide.functions.numeric import score_per_day

    rows = views.threaded(spark, sf_dir).withColumn(
        "comment_score_per_day", score_per_day("comment_score", "comment_created_utc", "post_created_utc")
    )
    # every fit and score reads the joined columns again, so they are joined once and written
    path, rows = scratch_path(spark, "scored"), rows.select("comment_score", "post_score", "comment_score_per_day")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    flagged = features.leaking(["comment_score_per_day", "post_score"])
    out = None
    for name, numeric in [("with leak", ["post_score", "comment_score_per_day"]), ("without", ["post_score"])]:
        fit = models.fit_with_features(models.linear_regression("comment_score"), numeric=numeric)
        part = models.regression_metrics(fit(rows).transform(rows), "comment_score").select(
            F.lit(name).alias("inputs"), F.lit(",".join(c for c in numeric if c in flagged)).alias("flagged"), "n", F.round("r2", 4).alias("r2")
        )
        out = part if out is None else out.unionAll(part)
    return out
