"""Sources, selection, joins and ranking over the driver tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from threadtide.operators import hypothesis, selection, summary, threads
from threadtide.operators.grid import densify
from threadtide.schema import PERIODS
from threadtide.session import scratch_path
from threadtide.sources import dictionaries, reports, tables
from threadtide.sources.events import EventWindow, event_dimension
from workload import views
from workload.registry import query
from workload.views import LABELLED_SQL, POST_EVENTS_SQL, rounded, seconds_text, table

# --- sources and sinks -------------------------------------------------------------------------

RAW_SQL = f"""WITH {POST_EVENTS_SQL}
SELECT event_name, l_orderkey AS post_id, l_orderkey * 10 + l_linenumber AS comment_id,
       l_extendedprice AS comment_score, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS created
FROM post_events JOIN orders ON o_orderdate BETWEEN start_ts AND end_ts JOIN lineitem ON l_orderkey = o_orderkey"""


def _landed(spark, sf_dir):
    events = event_dimension(spark, views.POST_EVENTS)
    rows = threads.flatten_threads(
        threads.assign_events(views.posts(spark, sf_dir), "post_created_utc", events), views.comments(spark, sf_dir)
    ).select("event_name", "post_id", "comment_id", "comment_score", "comment_created_utc")
    path = scratch_path(spark, "raw")
    tables.write_raw(rows, path)
    return tables.read_raw(spark, path, rows.schema)


@query("s01_raw_landing", RAW_SQL)
def _(spark, sf_dir):
    rows = _landed(spark, sf_dir)
    return rows.select("event_name", "post_id", "comment_id", "comment_score", seconds_text("comment_created_utc").alias("created"))


@query("s02_raw_replay", f"""SELECT event_name, count(*) AS n, round(sum(comment_score), 2) AS total, TRUE AS has_file
FROM ({RAW_SQL}) GROUP BY event_name""")
def _(spark, sf_dir):
    return _landed(spark, sf_dir).groupBy("event_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("comment_score"), 2).alias("total"),
        F.bool_and(F.col("source_file").endswith(".json")).alias("has_file"),
    )


FLAGGED_SQL = "SELECT event_id, event_type, value, value > 50 AS high, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM events"


def _stored(spark, sf_dir):
    df = views.activity(spark, sf_dir).select("event_id", "event_type", "value", (F.col("value") > 50).alias("high"), "ts")
    path = scratch_path(spark, "processed")
    tables.write_processed(df, path, partition="event_type")
    return path, df.schema


@query("s03_processed_write", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high FROM events GROUP BY event_type")
def _(spark, sf_dir):
    path, schema = _stored(spark, sf_dir)
    return tables.read_processed(spark, path, schema).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("high").alias("n_high")
    )


@query("s04_processed_read", FLAGGED_SQL)
def _(spark, sf_dir):
    path, schema = _stored(spark, sf_dir)
    df = tables.read_processed(spark, path, schema)
    return df.select("event_id", "event_type", "value", "high", seconds_text("ts").alias("created"))


@query("s05_has_rows", "SELECT count(*) > 0 AS stored, FALSE AS absent, count(*) AS n FROM documents")
def _(spark, sf_dir):
    stored = tables.has_rows(spark, f"{sf_dir}/documents.parquet")
    absent = tables.has_rows(spark, f"{sf_dir}/no_such_table.parquet")
    return table(spark, sf_dir, "documents").agg(
        F.lit(stored).alias("stored"), F.lit(absent).alias("absent"), F.count(F.lit(1)).alias("n")
    )


@query("s06_load_or_build", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf_dir):
    path = scratch_path(spark, "built")
    build = lambda: table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    tables.load_or_build(spark, path, build)

    def must_not_build():
        raise AssertionError("the stored table was not used")

    return tables.load_or_build(spark, path, must_not_build)


@query("s07_dictionary", "SELECT DISTINCT p_type AS category, p_brand AS keyword FROM part")
def _(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    repeated = pairs.unionAll(pairs)
    lists = repeated.groupBy("p_type").agg(F.collect_list("p_brand").alias("items"))
    whole = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "items")))).alias("value"))
    path = scratch_path(spark, "dictionary")
    whole.write.text(path)
    return dictionaries.load_dictionary(spark, path)


@query("s08_event_dimension", f"""WITH {LABELLED_SQL}
SELECT event_name, strftime(pre_start_ts, '%Y-%m-%d %H:%M:%S') AS pre, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_at,
       strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_at, strftime(post_end_ts, '%Y-%m-%d %H:%M:%S') AS post, count(*) AS n
FROM labelled WHERE ts BETWEEN pre_start_ts AND post_end_ts GROUP BY ALL""")
def _(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).where(F.col("ts").between(F.col("pre_start_ts"), F.col("post_end_ts")))
    return rows.groupBy(
        "event_name", seconds_text("pre_start_ts").alias("pre"), seconds_text("start_ts").alias("start_at"),
        seconds_text("end_ts").alias("end_at"), seconds_text("post_end_ts").alias("post"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("s09_report_sink", f"""WITH {LABELLED_SQL}
SELECT 'Periods' AS title, event_name, time_period, count(*) AS count FROM labelled GROUP BY ALL""")
def _(spark, sf_dir):
    sizes = summary.group_sizes(views.labelled(spark, sf_dir), "event_name", "time_period")
    path = scratch_path(spark, "report")
    reports.write_report(sizes, path, "Periods")
    return spark.read.schema("title string, event_name string, time_period string, count bigint").option("header", True).csv(path)


@query("s11_metrics_summary", """SELECT * FROM (
  SELECT 'guess' AS model, 'mse' AS metric, round(avg((l_extendedprice - 2000 * l_quantity) ** 2), 2) AS value, 'v1' AS version FROM lineitem
  UNION ALL SELECT 'guess', 'n', count(*)::DOUBLE, 'v1' FROM lineitem)""")
def _(spark, sf_dir):
    error = F.pow(F.col("l_extendedprice") - 2000 * F.col("l_quantity"), F.lit(2.0))
    row = table(spark, sf_dir, "lineitem").agg(F.avg(error).alias("mse"), F.count(F.lit(1)).alias("n")).first()
    path = scratch_path(spark, "metrics")
    reports.append_metrics(reports.metrics_table(spark, {"guess": row.asDict()}, {"version": "v1"}), path)
    return spark.read.parquet(path).select("model", "metric", F.round("value", 2).alias("value"), F.col("params")["version"].alias("version"))


# --- projections, filters, predicates ------------------------------------------------------------

@query("p01_null_body", "SELECT doc_id, lang FROM documents WHERE lang <> 'de'")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("body", F.nullif("lang", F.lit("de")))
    return selection.drop_blank(docs, "body").select("doc_id", "lang")


@query("p02_drop_blank", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(replace(text, role, ''), '\\S') AND role <> 'system'")
def _(spark, sf_dir):
    blanked = F.when(F.col("role") == "system", F.lit(" \t\n")).otherwise(F.replace("text", F.col("role"), F.lit("")))
    return selection.drop_blank(table(spark, sf_dir, "conversations").withColumn("body", blanked), "body").select("conv_id", "turn")


@query("p03_drop_deleted", "SELECT conv_id, turn, nullif(role, 'system') AS author FROM conversations WHERE role <> 'assistant'")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "assistant", "[deleted]").when(F.col("role") != "system", F.col("role")).alias("author"),
    )
    return selection.drop_deleted(rows, "author")


WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8232) || chr(12288)"


@query("p04_trim_drop_empty", f"""SELECT conv_id, turn, length(b) AS n, md5(b) AS digest
FROM (SELECT *, trim(chr(160) || text || chr(10) || ' ', {WHITE}) AS b FROM conversations) WHERE b <> '' AND role <> 'system'""")
def _(spark, sf_dir):
    padded = F.concat(F.lit(" "), F.when(F.col("role") != "system", F.col("text")).otherwise(F.lit(" ")), F.lit("\n "))
    rows = selection.trim_and_drop_empty(table(spark, sf_dir, "conversations").withColumn("b", padded), "b")
    return rows.select("conv_id", "turn", F.length("b").cast("bigint").alias("n"), F.md5("b").alias("digest"))


@query("p05_require_columns", "SELECT event_id, value FROM events WHERE value <= 50 AND event_type <> 'error'")
def _(spark, sf_dir):
    v = F.when(F.col("value") <= 50, F.col("value")).otherwise(F.lit(float("nan")))
    rows = views.activity(spark, sf_dir).select("event_id", v.alias("value"), F.nullif("event_type", F.lit("error")).alias("kind"))
    return selection.require(rows, "value", "kind").select("event_id", "value")


@query("p06_membership", """SELECT 'some' AS choice, count(*) AS n FROM conversations WHERE role IN ('user', 'system')
UNION ALL SELECT 'all', count(*) FROM conversations""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    count = lambda label, values: selection.only_values(rows, "role", values).agg(F.lit(label).alias("choice"), F.count(F.lit(1)).alias("n"))
    return count("some", ["user", "system"]).unionAll(count("all", None))


@query("p07_two_groups", """SELECT count(*) FILTER (event_type = 'click') AS n1, round(avg(value) FILTER (event_type = 'click'), 6) AS mean1,
  round(var_samp(value) FILTER (event_type = 'click'), 6) AS var1, count(*) FILTER (event_type = 'error') AS n2,
  round(avg(value) FILTER (event_type = 'error'), 6) AS mean2, round(var_samp(value) FILTER (event_type = 'error'), 6) AS var2 FROM events""")
def _(spark, sf_dir):
    return rounded(selection.two_groups(views.activity(spark, sf_dir), "event_type", "value", "click", "error"))


@query("p08_date_window", "SELECT o_orderkey AS post_id FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31 23:59:59'")
def _(spark, sf_dir):
    kept = selection.in_window(
        views.posts(spark, sf_dir), "post_created_utc",
        F.to_timestamp(F.lit("1997-01-01 00:00:00")), F.to_timestamp(F.lit("1997-03-31 23:59:59")),
    )
    return kept.select("post_id")


@query("p09_constants", "SELECT event_id, 'E1' AS event_name, 0::INTEGER AS author_karma FROM events")
def _(spark, sf_dir):
    return selection.add_constants(views.activity(spark, sf_dir).select("event_id"), event_name="E1", author_karma=0)


@query("p10_drop_columns", "SELECT c_custkey, c_nationkey FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").drop("c_name", "c_acctbal", "c_mktsegment")


@query("p11_numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(*selection.numeric_columns(part, ["p_name", "p_partkey", "absent", "p_size", "p_brand", "p_retailprice"]))


@query("p12_defaults", """SELECT doc_id, lang AS post_type, '' AS processed_comment_body, 'Unknown' AS time_period, FALSE AS contains_team_name,
  NULL::DOUBLE AS char_count, 0::INTEGER AS post_title_length FROM documents""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("post_type"))
    return selection.with_feature_defaults(docs).select(
        "doc_id", "post_type", "processed_comment_body", "time_period", "contains_team_name", "char_count", "post_title_length"
    )


@query("p13_validation", """SELECT * FROM (VALUES ('completed', NULL), ('error', 'Column ''missing'' not found.'),
  ('error', 'Column ''event_type'' is not numeric.'), ('skipped', 'A group has no values.')) v(status, reason)""")
def _(spark, sf_dir):
    df = views.activity(spark, sf_dir)
    cases = [("event_type", "value", "click", "error"), ("missing", "value", "a", "b"),
             ("user_id", "event_type", 1, 2), ("event_type", "value", "click", "nobody")]
    rows = [hypothesis.t_test(df, *c).select("status", "reason") for c in cases]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


# --- joins ----------------------------------------------------------------------------------------

@query("j01_flatten_threads", """SELECT o_orderkey AS post_id, l_orderkey * 10 + l_linenumber AS comment_id, o_totalprice AS post_score,
  l_extendedprice AS comment_score FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def _(spark, sf_dir):
    return views.threaded(spark, sf_dir).select("post_id", "comment_id", "post_score", "comment_score")


@query("j02_event_assignment", f"""WITH {POST_EVENTS_SQL}
SELECT event_name, o_orderkey AS post_id FROM orders JOIN post_events ON o_orderdate BETWEEN start_ts AND end_ts
WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus), query)""")
def _(spark, sf_dir):
    events = event_dimension(spark, views.POST_EVENTS)
    rows = threads.assign_events(views.posts(spark, sf_dir), "post_created_utc", events, ["post_title", "selftext"])
    return rows.select("event_name", "post_id")


@query("j02_event_assignment_many", """SELECT s.event_id AS window_id, e.event_id FROM events e JOIN events s
  ON s.event_type = 'purchase' AND e.ts BETWEEN s.ts AND s.ts + INTERVAL 30 MINUTE""")
def _(spark, sf_dir):
    # thousands of windows: the equi-join on time buckets with the range condition
    rows = views.activity(spark, sf_dir)
    windows = rows.where("event_type = 'purchase'").select(
        F.col("event_id").alias("window_id"), F.col("ts").alias("start_ts"),
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("end_ts"), F.lit("").alias("query"),
    )
    return threads.assign_events(rows.select("event_id", "ts"), "ts", windows).select("window_id", "event_id")


@query("j02_no_events", "SELECT 'none' AS event_name, o_orderkey AS post_id FROM orders WHERE FALSE")
def _(spark, sf_dir):
    none = event_dimension(spark, [])
    return threads.assign_events(views.posts(spark, sf_dir), "post_created_utc", none, ["post_title", "selftext"]).select("event_name", "post_id")


@query("j03_dense_grid", f"""WITH {LABELLED_SQL},
  cells AS (SELECT event_type, time_period, event_name, count(*) AS n FROM labelled WHERE event_type = 'error' OR time_period <> 'After Event' GROUP BY ALL),
  grid AS (SELECT * FROM (SELECT DISTINCT event_type FROM cells), (SELECT DISTINCT event_name FROM cells),
           (VALUES ('Before Event'), ('During Event'), ('After Event'), ('Outside Window')) p(time_period))
SELECT event_type, event_name, time_period, n FROM grid LEFT JOIN cells USING (event_type, event_name, time_period)""")
def _(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).where("event_type = 'error' OR time_period <> 'After Event'")
    cells = rows.groupBy("event_type", "event_name", "time_period").agg(F.count(F.lit(1)).alias("n"))
    return densify(cells, {"event_type": None, "event_name": None, "time_period": PERIODS})


TABLE_WORDS = ["thing", "license", "worthless", "Of The", "the and attion to", "the, anea", "version 2.0", "ernt."]
_WORD = r"[^\p{L}\p{M}\p{Nd}_]"


@query("j04_keyword_semi_join", f"""SELECT doc_id FROM documents WHERE regexp_matches(lower(text),
  '(^|{_WORD})(thing|license|worthless|of the|the and attion to|the, anea|version 2\\.0)($|{_WORD})|(^|{_WORD})ernt\\.[\\p{{L}}\\p{{M}}\\p{{Nd}}_]')""")
def _(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in TABLE_WORDS], "keyword string")
    docs = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return threads.keyword_rows(docs, "doc_id", "text", words)


@query("j04_large_dictionary", f"""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|{_WORD})(thing|worthless|the and attion to)($|{_WORD})')""")
def _(spark, sf_dir):
    # a dictionary beyond any broadcast or literal: the table is joined
    filler = table(spark, sf_dir, "orders").select(F.concat(F.lit("filler"), "o_orderkey").alias("keyword"))
    words = spark.createDataFrame([("thing",), ("worthless",), ("the and attion to",)], "keyword string").unionAll(filler)
    return threads.keyword_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", words)


@query("j05_counts_and_shares", """SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY event_type""")
def _(spark, sf_dir):
    rows = views.activity(spark, sf_dir)
    sizes = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rounded(sizes.withColumn("pct", F.lit(100.0) * F.col("n") / total))


# --- dedup, set operations, top-k -------------------------------------------------------------------

FIRST_COMMENT = """SELECT comment_id, l_partkey, l_suppkey, comment_score FROM (
  SELECT l_orderkey * 10 + l_linenumber AS comment_id, l_partkey, l_suppkey, l_extendedprice AS comment_score,
         row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem) WHERE rn = 1"""


@query("d01_dedup_first", FIRST_COMMENT)
def _(spark, sf_dir):
    order = [F.asc(c) for c in ("comment_created_utc", "l_partkey", "l_suppkey", "comment_score")]
    rows = threads.first_per_key(views.comments(spark, sf_dir), ["comment_id"], order)
    return rows.select("comment_id", "l_partkey", "l_suppkey", "comment_score")


@query("d02_merge_listings", """SELECT o_orderkey AS post_id, CASE WHEN o_totalprice > 200000 THEN 'top' ELSE 'search' END AS listing
FROM orders WHERE o_totalprice > 200000 OR o_orderstatus = 'F'""")
def _(spark, sf_dir):
    posts = views.posts(spark, sf_dir)
    found = posts.where("selftext = 'F'").select("post_id", F.lit("search").alias("listing"))
    best = posts.where("post_score > 200000").select("post_id", F.lit("top").alias("listing"))
    return threads.merge_listings([found, best], ["post_id"])


@query("d03_union_events", f"""WITH {POST_EVENTS_SQL}
SELECT event_name, o_orderkey AS post_id FROM post_events JOIN orders ON o_orderdate BETWEEN start_ts AND end_ts""")
def _(spark, sf_dir):
    posts = views.posts(spark, sf_dir)
    parts = [
        selection.add_constants(selection.in_window(posts, "post_created_utc", w.start, w.end), event_name=w.event_name)
        for w in views.POST_EVENTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("event_name", "post_id")


@query("d04_top_posts_per_event", f"""WITH {POST_EVENTS_SQL}
SELECT event_name, o_orderkey AS post_id, o_totalprice AS post_score FROM post_events JOIN orders ON o_orderdate BETWEEN start_ts AND end_ts
QUALIFY row_number() OVER (PARTITION BY event_name ORDER BY o_totalprice DESC, o_orderkey) <= 15""")
def _(spark, sf_dir):
    events = event_dimension(spark, views.POST_EVENTS)
    rows = threads.assign_events(views.posts(spark, sf_dir), "post_created_utc", events)
    best = threads.top_n(rows, ["event_name"], [F.desc("post_score"), F.asc("post_id")], threads.MAX_POSTS)
    return best.select("event_name", "post_id", "post_score")


@query("d05_top_comments_per_post", """SELECT l_suppkey AS post_id, l_extendedprice AS comment_score FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) <= 50""")
def _(spark, sf_dir):
    rows = views.comments(spark, sf_dir).select(F.col("l_suppkey").alias("post_id"), "comment_score")
    return threads.top_n(rows, ["post_id"], [F.desc("comment_score")], threads.COMMENT_LIMIT)


@query("d06_top_ranked", "SELECT p_name, max(p_retailprice) AS price FROM part GROUP BY p_name ORDER BY price DESC, p_name LIMIT 10")
def _(spark, sf_dir):
    ranked = table(spark, sf_dir, "part").groupBy("p_name").agg(F.max("p_retailprice").alias("price"))
    return ranked.orderBy(F.desc("price"), "p_name").limit(10)


@query("d07_search_posts", """SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')
ORDER BY n_chars DESC, doc_id LIMIT 1000""")
def _(spark, sf_dir):
    docs = tables.spread(table(spark, sf_dir, "documents"))
    return threads.search_posts(docs, "License the", ["text"], "n_chars", "doc_id").select("doc_id", "n_chars")


@query("d07_top_of_year", """SELECT o_orderkey AS post_id, o_totalprice AS post_score FROM orders WHERE o_orderdate > TIMESTAMP '1997-08-01'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def _(spark, sf_dir):
    rows = threads.top_since(views.posts(spark, sf_dir), "post_created_utc", datetime(1997, 8, 1), "post_score", "post_id")
    return rows.select("post_id", "post_score")


@query("d08_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def _(spark, sf_dir):
    return views.activity(spark, sf_dir).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("d09_category_order", f"""WITH {LABELLED_SQL}
SELECT list_position(['Before Event', 'During Event', 'After Event', 'Outside Window'], time_period)::BIGINT AS place, time_period, count(*) AS count
FROM labelled GROUP BY ALL ORDER BY place""")
def _(spark, sf_dir):
    sizes = summary.group_sizes(views.labelled(spark, sf_dir), "time_period")
    place = F.array_position(F.array(*[F.lit(p) for p in PERIODS]), F.col("time_period"))
    return summary.in_category_order(sizes, "time_period", PERIODS).select(place.alias("place"), "time_period", "count")


@query("d10_column_order", f"""WITH {LABELLED_SQL}
SELECT column_no::BIGINT AS column_no, column_name, n FROM (SELECT count(*) AS n FROM labelled),
 (VALUES (0, 'event_name'), (1, 'before_event'), (2, 'during_event'), (3, 'after_event'), (4, 'outside_window'),
         (5, 'before_event_pct'), (6, 'during_event_pct'), (7, 'after_event_pct'), (8, 'outside_window_pct')) v(column_no, column_name)""")
def _(spark, sf_dir):
    rows = views.labelled(spark, sf_dir)
    names = [F.struct(F.lit(i).cast("bigint").alias("column_no"), F.lit(c).alias("column_name")) for i, c in enumerate(summary.period_table(rows).columns)]
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*names)), "n")


FULL_COLLECTION = f"""WITH {POST_EVENTS_SQL},
  matched AS (SELECT * FROM post_events, orders WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus), query)
              QUALIFY row_number() OVER (PARTITION BY event_name ORDER BY o_totalprice DESC, o_orderkey) <= 1000),
  recent AS (SELECT * FROM post_events, (SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000)),
  inside AS (SELECT DISTINCT event_name, o_orderkey, o_totalprice FROM (SELECT * FROM matched UNION ALL SELECT * FROM recent)
             WHERE o_orderdate BETWEEN start_ts AND end_ts),
  chosen AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY event_name ORDER BY o_totalprice DESC, o_orderkey) <= 15)
SELECT event_name, o_orderkey AS post_id, l_orderkey * 10 + l_linenumber AS comment_id, l_extendedprice AS comment_score
FROM chosen JOIN lineitem ON l_orderkey = o_orderkey
QUALIFY row_number() OVER (PARTITION BY event_name, o_orderkey ORDER BY l_extendedprice DESC, comment_id, l_shipdate) <= 3"""


@query("d05_collect_threads", FULL_COLLECTION)
def _(spark, sf_dir):
    rows = threads.collect_threads(
        views.posts(spark, sf_dir), views.comments(spark, sf_dir), event_dimension(spark, views.POST_EVENTS),
        listing_since=datetime(1996, 6, 1), comment_limit=3,
    )
    return rows.select("event_name", "post_id", "comment_id", "comment_score")


MANY_QUERIES = ["low", "f", "p", "high", "o"]
MANY_EVENTS_SQL = f"""
  post_events AS (SELECT 'W' || i AS event_name, {MANY_QUERIES}[(i % 5)::INTEGER + 1] AS query, TIMESTAMP '1995-01-01' + (3 * i) * INTERVAL 1 DAY AS start_ts,
                  TIMESTAMP '1995-01-01' + (3 * i + 20) * INTERVAL 1 DAY AS end_ts FROM range(300) r(i))"""


@query("d05_collect_threads_many", FULL_COLLECTION.replace(POST_EVENTS_SQL, MANY_EVENTS_SQL))
def _(spark, sf_dir):
    first = datetime(1995, 1, 1)
    windows = [
        EventWindow(f"W{i}", first + timedelta(days=3 * i), first + timedelta(days=3 * i + 20), MANY_QUERIES[i % 5]) for i in range(300)
    ]
    rows = threads.collect_threads(
        views.posts(spark, sf_dir), views.comments(spark, sf_dir), event_dimension(spark, windows),
        listing_since=datetime(1996, 6, 1), comment_limit=3,
    )
    return rows.select("event_name", "post_id", "comment_id", "comment_score")
