"""Grouped tables, distributions, tests and correlation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtide.functions import temporal
from threadtide.operators import bootstrap, correlation, distribution, hypothesis, summary, threads
from threadtide.plans import report as reports
from threadtide.schema import PERIODS, WEEKDAYS
from threadtide.sources.events import event_dimension
from threadtide.sources.tables import spread
from workload import views
from workload.registry import query
from workload.views import EVENTS_SQL, LABELLED_SQL, rounded, table

SUMMARY = """round(avg({v}), {p}) AS mean, round(stddev_samp({v}), {p}) AS std, round(quantile_cont({v}, 0.5), {p}) AS median, count({v}) AS count,
  round(avg({v}) - stddev_samp({v}), {p}) AS lower_bound, round(avg({v}) + stddev_samp({v}), {p}) AS upper_bound"""
SUMMARY_COLUMNS = "mean, std, median, count, lower_bound, upper_bound"


@query("a01_period_event_summary", f"""WITH {LABELLED_SQL},
  cells AS (SELECT time_period, event_name, {SUMMARY.format(v='value', p=6)} FROM labelled GROUP BY ALL)
SELECT time_period, event_name, {SUMMARY_COLUMNS} FROM (VALUES ('Before Event'), ('During Event'), ('After Event'), ('Outside Window')) p(time_period)
CROSS JOIN (SELECT DISTINCT event_name FROM cells) LEFT JOIN cells USING (time_period, event_name)""")
def _(spark, sf_dir):
    return rounded(summary.summary_by_period_and_event(views.labelled(spark, sf_dir), "value"))


@query("a02_type_event_summary", f"""WITH {LABELLED_SQL},
  cells AS (SELECT event_type, event_name, {SUMMARY.format(v='value', p=6)} FROM labelled
            WHERE event_type IN ('click', 'error', 'view') AND NOT (event_type = 'view' AND event_name = 'E2') GROUP BY ALL)
SELECT event_type, event_name, {SUMMARY_COLUMNS} FROM (SELECT DISTINCT event_type FROM cells)
CROSS JOIN (SELECT DISTINCT event_name FROM cells) LEFT JOIN cells USING (event_type, event_name)""")
def _(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).where("NOT (event_type = 'view' AND event_name = 'E2')")
    return rounded(summary.summary_by_type_and_event(rows, "value", ["click", "error", "view"], post_type="event_type"))


@query("a03_event_summary", """SELECT l_returnflag AS event_name, count(*) AS count, round(avg(l_extendedprice), 4) AS mean,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min,
  max(l_extendedprice) AS max, round(avg(l_extendedprice) - stddev_samp(l_extendedprice), 4) AS lower_bound,
  round(avg(l_extendedprice) + stddev_samp(l_extendedprice), 4) AS upper_bound FROM lineitem GROUP BY 1""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "event_name")
    return rounded(summary.summary_by_event(rows, "l_extendedprice"), 4)


@query("a04_two_key_summary", """SELECT l_suppkey, l_returnflag, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median,
  round(stddev_samp(l_quantity), 6) AS std, count(*) AS count FROM lineitem GROUP BY ALL""")
def _(spark, sf_dir):
    return rounded(summary.summary_by(table(spark, sf_dir, "lineitem"), "l_quantity", "l_suppkey", "l_returnflag"))


@query("a05_overall_summary", """SELECT round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
  round(stddev_samp(o_totalprice), 4) AS std, count(*) AS count, round(avg(o_totalprice) - stddev_samp(o_totalprice), 4) AS lower_bound,
  round(avg(o_totalprice) + stddev_samp(o_totalprice), 4) AS upper_bound FROM orders""")
def _(spark, sf_dir):
    return rounded(summary.summary_overall(table(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("a06_group_sizes", "SELECT role, turn, count(*) AS count FROM conversations GROUP BY ALL")
def _(spark, sf_dir):
    return summary.group_sizes(table(spark, sf_dir, "conversations"), "role", "turn")


PERIOD_COUNTS = ", ".join(f"count(*) FILTER (time_period = '{p}') AS {summary.column_name(p)}" for p in PERIODS)
PERIOD_SHARES = ", ".join(
    f"round(100.0 * count(*) FILTER (time_period = '{p}') / count(*), 6) AS {summary.column_name(p)}_pct" for p in PERIODS
)


@query("a07_period_table", f"WITH {LABELLED_SQL} SELECT event_name, {PERIOD_COUNTS}, {PERIOD_SHARES} FROM labelled GROUP BY event_name")
def _(spark, sf_dir):
    return rounded(summary.period_table(views.labelled(spark, sf_dir)))


@query("a08_mean_matrix", """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F,
  round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, NULL::DOUBLE AS Z FROM orders GROUP BY 1""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "event_name").where("event_name <> 'P'")
    return rounded(summary.mean_matrix(rows, "o_orderpriority", "o_totalprice", ["F", "O", "Z"]), 4)


@query("a09_keyword_share", """SELECT source, round(100.0 * count(*) FILTER (lang = 'en') / (SELECT count(*) FROM documents WHERE lang = 'en'), 6) AS en,
  round(100.0 * count(*) FILTER (lang = 'fr') / (SELECT count(*) FROM documents WHERE lang = 'fr'), 6) AS fr, 0.0::DOUBLE AS xx
FROM documents WHERE lang IN ('en', 'fr') GROUP BY source""")
def _(spark, sf_dir):
    return rounded(summary.keyword_share(table(spark, sf_dir, "documents"), "source", ["en", "fr", "xx"], event="lang"))


@query("a10_keyword_score_matrix", """SELECT source, coalesce(round(avg(n_chars) FILTER (lang = 'en'), 6), 0) AS en,
  coalesce(round(avg(n_chars) FILTER (lang = 'de'), 6), 0) AS de FROM documents GROUP BY source""")
def _(spark, sf_dir):
    return rounded(summary.mean_matrix(table(spark, sf_dir, "documents"), "source", "n_chars", ["en", "de"], event="lang", fill=0.0))


@query("a11_engagement_by_weekday", f"""WITH {LABELLED_SQL} SELECT list_position({WEEKDAYS}, dayname(ts))::BIGINT AS sort_idx, dayname(ts) AS weekday, event_name,
  round(avg(value), 6) AS mean FROM labelled WHERE time_period <> 'Outside Window' GROUP BY ALL""")
def _(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).where("time_period <> 'Outside Window'")
    return rounded(summary.engagement_by_weekday(rows, "ts", "value"))


def _profile_sql(name: str, text: str) -> str:
    return f"""SELECT '{name}' AS "column", '{text}' AS type, count({name}) AS count, count(DISTINCT {name}) AS "unique",
  (SELECT CAST({name} AS VARCHAR) FROM supplier WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
  (SELECT count(*) FROM supplier WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY count(*) DESC LIMIT 1) AS freq, """ + (
        "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75"
        if text == "string" else
        f"""round(avg({name}), 4) AS mean, round(stddev_samp({name}), 4) AS std, min({name})::DOUBLE AS min, max({name})::DOUBLE AS max,
  round(quantile_cont({name}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({name}::DOUBLE, 0.5), 4) AS q50, round(quantile_cont({name}::DOUBLE, 0.75), 4) AS q75"""
    ) + " FROM supplier"


@query("a12_profile", " UNION ALL ".join(
    _profile_sql(n, t) for n, t in [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")]))
def _(spark, sf_dir):
    return rounded(summary.profile(table(spark, sf_dir, "supplier")), 4)


@query("a13_class_counts", """SELECT c AS event_type, count(event_id) AS count, count(event_id) = 0 AS is_empty
FROM (VALUES ('click'), ('error'), ('absent')) v(c) LEFT JOIN events ON event_type = c GROUP BY c""")
def _(spark, sf_dir):
    return summary.class_counts(views.activity(spark, sf_dir), "event_type", ["click", "error", "absent"])


@query("a14_cleaning_audit", """WITH s AS (SELECT count(*) AS n0, count(*) FILTER (turn > 0) AS n1, count(*) FILTER (turn > 0 AND role <> 'system') AS n2,
  count(*) FILTER (turn > 0 AND role <> 'system' AND length(text) > 200) AS n3 FROM conversations)
SELECT 1 AS step_no, 'not first' AS step, n0 AS rows_in, n1 AS rows_out, n0 - n1 AS removed FROM s
UNION ALL SELECT 2, 'not system', n1, n2, n1 - n2 FROM s UNION ALL SELECT 3, 'long', n2, n3, n2 - n3 FROM s""")
def _(spark, sf_dir):
    steps = [("not first", F.col("turn") > 0), ("not system", F.col("role") != "system"), ("long", F.length("text") > 200)]
    return summary.cleaning_audit(table(spark, sf_dir, "conversations"), steps)


@query("a15_nonempty_texts", "SELECT count(*) FILTER (length(trim(text)) > 0 AND lang <> 'fr') AS non_empty, count(*) AS rows FROM documents")
def _(spark, sf_dir):
    body = F.when(F.col("lang") == "fr", F.lit(" \n")).otherwise(F.col("text"))
    return summary.nonempty_texts(table(spark, sf_dir, "documents").withColumn("body", body), "body")


# --- distributions ---------------------------------------------------------------------------------

def _histogram_sql(source: str, value: str, bins: int, key: str | None = None) -> str:
    keys = f"{key}, " if key else ""
    groups = f"CROSS JOIN (SELECT DISTINCT {key} FROM v)" if key else ""
    return f"""WITH v AS (SELECT {keys}{value}::DOUBLE AS x FROM {source}), l AS (SELECT min(x) AS a, max(x) AS z, (max(x) - min(x)) / {bins} AS w FROM v),
  c AS (SELECT {keys}least(floor((x - a) / w), {bins - 1})::BIGINT AS bin, count(*) AS n FROM v, l GROUP BY ALL)
SELECT {keys}bin, round(a + bin * w, 6) AS lo, round(CASE WHEN bin = {bins - 1} THEN z ELSE a + (bin + 1) * w END, 6) AS hi, coalesce(n, 0) AS count
FROM (SELECT unnest(range({bins})) AS bin) {groups} CROSS JOIN l LEFT JOIN c USING ({keys}bin)"""


@query("h01_histogram", _histogram_sql("lineitem", "l_extendedprice", 30))
def _(spark, sf_dir):
    return rounded(distribution.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("h02_histogram_by_event", _histogram_sql("events", "value", 50, "event_type"))
def _(spark, sf_dir):
    return rounded(distribution.histogram(views.activity(spark, sf_dir), "value", 50, ["event_type"]))


def _kde_sql(source: str, value: str, key: str | None = None) -> str:
    keys = f"{key}, " if key else ""
    join = f"JOIN c USING ({key})" if key else "CROSS JOIN c"
    group = "GROUP BY ALL" if key else ""
    return f"""WITH v AS (SELECT {keys}{value}::DOUBLE AS x FROM {source}), c AS (SELECT {keys}x AS y, count(*) AS n FROM v GROUP BY ALL),
  s AS (SELECT {keys}count(*) AS n_all, min(x) AS a, max(x) AS z, pow(count(*), -0.2) * stddev_samp(x) AS h FROM v {group}),
  g AS (SELECT *, a + i * (z - a) / 199 AS p FROM s CROSS JOIN (SELECT unnest(range(200)) AS i))
SELECT {keys}i::INTEGER AS i, round(any_value(p), 6) AS x, round(sum(n * exp(-0.5 * ((p - y) / h) ** 2)) / any_value(n_all * h * sqrt(2 * pi())), 10) AS kde_density
FROM g {join} GROUP BY {keys}i"""


def _kde_rounded(df):
    return df.withColumns({"x": F.round("x", 6), "kde_density": F.round("kde_density", 10)})


@query("h03_kde_curve", _kde_sql("events", "value"))
def _(spark, sf_dir):
    return _kde_rounded(distribution.kde_curve(views.activity(spark, sf_dir), "value"))


@query("h04_kde_by_event", _kde_sql("lineitem", "l_quantity", "l_returnflag"))
def _(spark, sf_dir):
    return _kde_rounded(distribution.kde_curve(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]))


@query("h04_quartiles", """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1""")
def _(spark, sf_dir):
    return rounded(distribution.quartiles(views.activity(spark, sf_dir), "value", "event_type"))


@query("h05_box_stats", """WITH q AS (SELECT lang, quantile_cont(n_chars::DOUBLE, 0.25) AS q25, quantile_cont(n_chars::DOUBLE, 0.5) AS q50, quantile_cont(n_chars::DOUBLE, 0.75) AS q75
  FROM documents GROUP BY 1), f AS (SELECT *, n_chars BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM documents JOIN q USING (lang))
SELECT lang, q25, q50, q75, min(n_chars) FILTER (inside)::DOUBLE AS whisker_low, max(n_chars) FILTER (inside)::DOUBLE AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers, count(*) AS count FROM f GROUP BY lang, q25, q50, q75""")
def _(spark, sf_dir):
    return distribution.box_stats(table(spark, sf_dir, "documents"), "n_chars", ["lang"])


@query("h06_category_histogram", "SELECT hour(ts)::BIGINT AS comment_hour, event_type, count(*) AS count FROM events GROUP BY ALL")
def _(spark, sf_dir):
    rows = views.activity(spark, sf_dir).withColumn("comment_hour", F.hour("ts").cast("bigint"))
    return distribution.category_histogram(rows, "comment_hour", "event_type")


@query("h07_weekday_hour_matrix", "SELECT dayname(ts) AS weekday, " + ", ".join(
    f"count(*) FILTER (hour(ts) = {h}) AS h{h:02d}" for h in range(24)) + " FROM events GROUP BY 1")
def _(spark, sf_dir):
    return distribution.weekday_hour_matrix(views.activity(spark, sf_dir), "ts")


@query("h08_line_table", """SELECT user_id, event_type, round(avg(value), 6) AS mean, count(*) AS count, round(stddev_samp(value), 6) AS std,
  round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci_low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci_high
FROM events GROUP BY ALL""")
def _(spark, sf_dir):
    return rounded(distribution.line_table(views.activity(spark, sf_dir), "user_id", "value", "event_type"))


BOUNDS_SQL = ", ".join(repr(s) for s in bootstrap.steps())
# the same counts: hash of the row's id, mixed with three numbers per replicate, through the steps of Poisson(1)
BOOTSTRAP_SQL = f"""WITH d AS (SELECT event_type, user_id % 10 AS decile, value, md5(event_id || '|42') AS h FROM events),
  rows_ AS (SELECT event_type, decile, value, ('0x' || substr(h, 1, 7))::BIGINT AS high, ('0x' || substr(h, 8, 7))::BIGINT AS low FROM d),
  reps AS (SELECT r, ('0x' || substr(md5('42|a|' || r), 1, 8))::BIGINT % {bootstrap.PRIME} AS a, ('0x' || substr(md5('42|b|' || r), 1, 8))::BIGINT % {bootstrap.PRIME} AS b,
    ('0x' || substr(md5('42|c|' || r), 1, 8))::BIGINT % {bootstrap.PRIME} AS c FROM (SELECT unnest(range({bootstrap.REPLICATES})) AS r)),
  drawn AS (SELECT event_type, decile, r, value, len(list_filter([{BOUNDS_SQL}]::DOUBLE[], lambda s: s < u)) AS w
    FROM (SELECT *, (((high * a + c) % {bootstrap.PRIME} + low * b) % {bootstrap.PRIME}) / {bootstrap.PRIME}::DOUBLE AS u FROM rows_, reps)),
  means AS (SELECT event_type, decile, r, sum(w * value) / nullif(sum(w), 0) AS m FROM drawn GROUP BY ALL),
  ends AS (SELECT event_type, decile, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM means GROUP BY ALL)
SELECT event_type, decile, round(avg(value), 6) AS mean, count(*) AS count, round(any_value(ci_low), 6) AS ci_low, round(any_value(ci_high), 6) AS ci_high
FROM rows_ JOIN ends USING (event_type, decile) GROUP BY ALL"""


@query("h08_bootstrap_interval", BOOTSTRAP_SQL)
def _(spark, sf_dir):
    rows = views.activity(spark, sf_dir).withColumn("decile", F.col("user_id") % 10)
    return rounded(bootstrap.bootstrap_line_table(rows, "decile", "value", "event_type", "event_id"))


@query("h09_dual_histogram", f"""SELECT 'l_quantity' AS feature, * FROM ({_histogram_sql("(SELECT * FROM lineitem WHERE l_discount > 0)", "l_quantity", 30)})
UNION ALL SELECT 'l_tax', * FROM ({_histogram_sql("(SELECT * FROM lineitem WHERE l_discount > 0)", "l_tax", 30)})""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_discount") > 0, F.col("l_tax")))
    return rounded(distribution.dual_histogram(rows, "l_quantity", "l_tax"))


@query("h10_period_counts", f"""WITH {LABELLED_SQL} SELECT list_position({PERIODS}, time_period)::BIGINT AS sort_idx, time_period, event_name, count(*) AS count
FROM labelled GROUP BY ALL""")
def _(spark, sf_dir):
    return distribution.period_counts(views.labelled(spark, sf_dir))


def _report_rows(spark, sf_dir):
    """Activity under the processed table's column names."""
    length = F.length("event_type").cast("double")
    return views.labelled(spark, sf_dir).select(
        "event_name", "time_period", F.col("value").alias("comment_score"), (F.col("user_id") % 31).alias("word_count"),
        (F.col("value") / 100 - length / 10).alias("compound_sentiment"), F.col("event_type").alias("post_type"),
        F.col("ts").alias("comment_created_utc"),
    )


@query("h11_report_set")
def _(spark, sf_dir):
    rows = _report_rows(spark, sf_dir)
    tables = reports.report(rows, ["click", "error"])
    out = None
    for name, part in tables.items():
        count = part.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows"))
        out = count if out is None else out.unionAll(count)
    return out


# --- tests and correlation ---------------------------------------------------------------------------

WELCH_SQL = """SELECT 'completed' AS status, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_statistic,
  round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df, round(m1, 6) AS group1_mean, round(m2, 6) AS group2_mean
FROM (SELECT count({v}) FILTER ({g} = '{a}') AS n1, avg({v}) FILTER ({g} = '{a}') AS m1, var_samp({v}) FILTER ({g} = '{a}') AS v1,
  count({v}) FILTER ({g} = '{b}') AS n2, avg({v}) FILTER ({g} = '{b}') AS m2, var_samp({v}) FILTER ({g} = '{b}') AS v2 FROM {t})"""


@query("q01_welch_t_test", WELCH_SQL.format(t="events", g="event_type", v="value", a="click", b="error"))
def _(spark, sf_dir):
    row = hypothesis.t_test(views.activity(spark, sf_dir), "event_type", "value", "click", "error")
    return row.select("status", F.round("t_statistic", 6).alias("t_statistic"), F.round("df", 4).alias("df"),
                      F.round("group1_mean", 6).alias("group1_mean"), F.round("group2_mean", 6).alias("group2_mean"))


ANOVA_SQL = """SELECT 'completed' AS status, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f_statistic, (k - 1)::BIGINT AS df_between, (n - k)::BIGINT AS df_within
FROM (SELECT count(*) AS k, sum(n) AS n, sum(n * (m - (SELECT avg({v}) FROM {t})) ** 2) AS ssb, sum(s) AS ssw
  FROM (SELECT {g}, count({v}) AS n, avg({v}) AS m, var_pop({v}) * count({v}) AS s FROM {t} GROUP BY {g}))"""


@query("q02_anova", ANOVA_SQL.format(t="events", g="event_type", v="value"))
def _(spark, sf_dir):
    row = hypothesis.anova(views.activity(spark, sf_dir), "event_type", "value")
    return row.select("status", F.round("f_statistic", 6).alias("f_statistic"), "df_between", "df_within")


EXPECTED_SQL = """WITH o AS (SELECT {a}, {b}, count(*) AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
  c AS (SELECT {a}, {b}, coalesce(n, 0) AS observed, (SELECT sum(n) FROM o x WHERE x.{a} = ra.{a}) * (SELECT sum(n) FROM o x WHERE x.{b} = cb.{b})::DOUBLE
        / (SELECT sum(n) FROM o) AS expected FROM (SELECT DISTINCT {a} FROM o) ra CROSS JOIN (SELECT DISTINCT {b} FROM o) cb LEFT JOIN o USING ({a}, {b}))"""


@query("q03_chi_squared", EXPECTED_SQL.format(t="lineitem", a="l_returnflag", b="l_linestatus") + """
SELECT 'completed' AS status, round(sum((observed - expected) ** 2 / expected), 6) AS chi2_statistic, 2::BIGINT AS dof FROM c""")
def _(spark, sf_dir):
    row = hypothesis.chi2_test(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return row.select("status", F.round("chi2_statistic", 6).alias("chi2_statistic"), "dof")


@query("q03_chi_squared_yates", EXPECTED_SQL.format(t="labels", a="quality", b="toxic") + """
SELECT 'completed' AS status, round(sum(greatest(abs(observed - expected) - 0.5, 0) ** 2 / expected), 6) AS chi2_statistic, 1::BIGINT AS dof FROM c""")
def _(spark, sf_dir):
    row = hypothesis.chi2_test(table(spark, sf_dir, "labels"), "quality", "toxic")
    return row.select("status", F.round("chi2_statistic", 6).alias("chi2_statistic"), "dof")


@query("q03_expected_counts", EXPECTED_SQL.format(t="conversations", a="role", b="turn") + " SELECT role, turn, observed, round(expected, 6) AS expected FROM c")
def _(spark, sf_dir):
    return rounded(hypothesis.contingency(table(spark, sf_dir, "conversations"), "role", "turn"))


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice", "deep", "zero"]
MODEL_SQL = "(SELECT *, CASE WHEN l_tax > 0.01 THEN l_discount > 0.05 END AS deep, 0 AS zero FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _correlated(spark, sf_dir):
    """Line items with their part, a flag with nulls, and a constant."""
    deep = F.when(F.col("l_tax") > 0.01, F.col("l_discount") > 0.05)
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumns({"deep": deep, "zero": F.lit(0)})


def _corr_sql(columns) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = lambda a, b: f"""SELECT '{a}' AS a, '{b}' AS b, CASE WHEN '{b}' <> 'zero' THEN round(corr({a}::DOUBLE, {b}::DOUBLE), 6) END AS r,
      count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM m"""
    return f"WITH m AS (SELECT * FROM {MODEL_SQL}) " + " UNION ALL ".join(one(a, b) for a, b in pairs)


@query("q04_correlation", _corr_sql(CORRELATED))
def _(spark, sf_dir):
    return rounded(correlation.correlation_pairs(_correlated(spark, sf_dir), CORRELATED))


@query("q04_correlation_native", _corr_sql(["l_quantity", "l_extendedprice", "deep", "zero"]))
def _(spark, sf_dir):
    return rounded(correlation.correlation_pairs(_correlated(spark, sf_dir), ["l_quantity", "l_extendedprice", "deep", "zero"]))


OFFSET_COLUMNS = [f"c{k}" for k in range(7)]
OFFSET_SQL = "(SELECT " + ", ".join(f"CASE WHEN l_linenumber % 7 <> {k} THEN l_extendedprice * {k + 1} + l_quantity * {7 - k} + 1000000 END AS c{k}" for k in range(7)) + " FROM lineitem)"


@query("q04_correlation_offset", _corr_sql(OFFSET_COLUMNS).replace(MODEL_SQL, OFFSET_SQL))
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[
        F.when(F.col("l_linenumber") % 7 != k, F.col("l_extendedprice") * (k + 1) + F.col("l_quantity") * (7 - k) + 1000000).alias(f"c{k}") for k in range(7)
    ])
    return rounded(correlation.correlation_pairs(rows, OFFSET_COLUMNS))


@query("q04_correlation_matrix", f"""WITH pairs AS ({_corr_sql(CORRELATED)})
SELECT * FROM pairs UNION ALL SELECT b, a, r, n FROM pairs
UNION ALL """ + " UNION ALL ".join(f"SELECT '{c}', '{c}', {'NULL' if c == 'zero' else '1.0'}, (SELECT count({c}) FROM {MODEL_SQL})" for c in CORRELATED))
def _(spark, sf_dir):
    return rounded(correlation.correlation_matrix(_correlated(spark, sf_dir), CORRELATED))


# p of a t statistic: one minus twice Simpson's sum of the density from 0 to |t|.
TAIL_SQL = """(SELECT 1 - 2 * sum(w * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (1 + x * x / df) ** (-(df + 1) / 2)) FROM
  (SELECT abs(t) * i / 4000 AS x, abs(t) / 12000 * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(4001) r(i)))"""
INTERPRETED_SQL = f"""WITH s AS (SELECT avg(value) FILTER (event_type = 'click') AS m1, avg(value) FILTER (event_type = 'error') AS m2,
    var_samp(value) FILTER (event_type = 'click') / count(value) FILTER (event_type = 'click') AS e1, var_samp(value) FILTER (event_type = 'error') / count(value) FILTER (event_type = 'error') AS e2,
    count(value) FILTER (event_type = 'click') AS n1, count(value) FILTER (event_type = 'error') AS n2 FROM events),
  t AS (SELECT *, (m1 - m2) / sqrt(e1 + e2) AS t, (e1 + e2) ** 2 / (e1 ** 2 / (n1 - 1) + e2 ** 2 / (n2 - 1)) AS df FROM s), p AS (SELECT *, {TAIL_SQL} AS p FROM t)
SELECT 'completed' AS status, round(p, 6) AS p_value, printf(CASE WHEN p < 0.05 THEN 'value differs significantly (p=%.3f) between click (mean %.2f) and error (mean %.2f).'
  ELSE 'value does not differ significantly (p=%.3f) between click (mean %.2f) and error (mean %.2f).' END, p, m1, m2) AS interpretation FROM p"""


@query("q05_interpretation", INTERPRETED_SQL)
def _(spark, sf_dir):
    df = views.activity(spark, sf_dir)
    row = hypothesis.t_test(df, "event_type", "value", "click", "error")
    return row.select("status", F.round("p_value", 6).alias("p_value"), "interpretation")


# Activity under the battery's columns: four windows as events, two flags.
BATTERY_EVENTS = ["E1", "E2", "E3", "E4"]
BATTERY_TABLE = f"""WITH {EVENTS_SQL}, four AS (SELECT * FROM events_dim
    UNION ALL SELECT 'E3', start_ts + INTERVAL 4 DAY, end_ts + INTERVAL 6 DAY, pre_start_ts, post_end_ts FROM events_dim WHERE event_name = 'E1'
    UNION ALL SELECT 'E4', start_ts - INTERVAL 5 DAY, end_ts - INTERVAL 5 DAY, pre_start_ts, post_end_ts FROM events_dim WHERE event_name = 'E2'),
  rows_ AS (SELECT event_name, {views.PERIOD_SQL} AS time_period, value AS comment_score, value / 100 - length(event_type) / 10.0 AS compound_sentiment, event_type AS post_type,
    user_id % 3 = 0 AS contains_question, event_id % 2 = 0 AS contains_team_name FROM events CROSS JOIN four
    WHERE event_name = 'E1' OR hour(ts) >= CASE event_name WHEN 'E2' THEN 3 WHEN 'E3' THEN 7 ELSE 11 END)"""


def _battery_rows(spark, sf_dir):
    first = event_dimension(spark, views.ACTIVITY_EVENTS)
    moved = lambda name, of, a, b: first.where(F.col("event_name") == of).select(
        F.lit(name).alias("event_name"), "query", (F.col("start_ts") + F.expr(f"INTERVAL {a} DAYS")).alias("start_ts"),
        (F.col("end_ts") + F.expr(f"INTERVAL {b} DAYS")).alias("end_ts"), "pre_start_ts", "post_end_ts",
    )
    events = first.unionByName(moved("E3", "E1", 4, 6)).unionByName(moved("E4", "E2", -5, -5))
    rows = threads.pair_with_events(views.activity(spark, sf_dir), events)
    from_hour = F.when(F.col("event_name") == "E2", 3).when(F.col("event_name") == "E3", 7).otherwise(11)
    return rows.where((F.col("event_name") == "E1") | (F.hour("ts") >= from_hour)).select(
        "event_name", temporal.period_label("ts", "start_ts", "end_ts", "pre_start_ts", "post_end_ts").alias("time_period"),
        F.col("value").alias("comment_score"), (F.col("value") / 100 - F.length("event_type") / 10).alias("compound_sentiment"),
        F.col("event_type").alias("post_type"), (F.col("user_id") % 3 == 0).alias("contains_question"), (F.col("event_id") % 2 == 0).alias("contains_team_name"),
    )


def _battery_sql() -> str:
    out = []
    for i, (kind, *args) in enumerate(reports.standard_battery(BATTERY_EVENTS)):
        if kind == "t_test":
            part = f"SELECT status, t_statistic AS s FROM ({WELCH_SQL.format(t='rows_', g=args[0], v=args[1], a=args[2], b=args[3])})"
        elif kind == "anova":
            part = f"SELECT status, f_statistic AS s FROM ({ANOVA_SQL.format(t='rows_', g=args[0], v=args[1])})"
        else:
            part = f"""SELECT 'completed' AS status, round(sum((observed - expected) ** 2 / expected), 6) AS s FROM
              ({EXPECTED_SQL.format(t='rows_', a=args[0], b=args[1])} SELECT * FROM c)"""
        out.append(f"SELECT {i} AS test_no, '{kind}' AS test, status, s AS statistic FROM ({part})")
    return BATTERY_TABLE + " " + " UNION ALL ".join(out)


@query("q06_battery", _battery_sql())
def _(spark, sf_dir):
    rows = reports.run_battery(_battery_rows(spark, sf_dir), reports.standard_battery(BATTERY_EVENTS))
    return rows.select("test_no", "test", "status", F.round("statistic", 6).alias("statistic"))
