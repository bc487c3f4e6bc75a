from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadtide.functions.lexicon import Lexicon
from threadtide.operators import models, threads
from threadtide.plans import prepare, report, train
from threadtide.schema import COMMENTS, POSTS, PROCESSED, RAW
from threadtide.sources import tables
from threadtide.sources.events import EventWindow, event_dimension

DAY = datetime(2024, 1, 10)
WORDS = prepare.Dictionaries(
    lexicon=Lexicon({"great": 3.0, "awful": -2.0}), teams=["og", "t1"], players=["zed"], heroes=["io"],
    event_words=["final"], post_types={"Player Transfer": ["joins"], "Tournament Result": ["wins"]},
)


def threads_of(spark):
    posts = [
        ("p1", "OG wins the cup", "u", "x", DAY, 50, 3, 0.9, True, "what a day", "news", "/1"),
        ("p2", "og quiet", "u", "x", DAY + timedelta(days=1), 10, 3, 0.9, False, "", None, "/2"),
        ("p3", "OG before", "u", "x", DAY - timedelta(days=1), 99, 3, 0.9, False, "", None, "/3"),
        ("p4", "other", "u", "x", DAY, 99, 3, 0.9, False, "", None, "/4"),
        ("p5", "og joins, nobody answers", "u", "x", DAY, 5, 0, 0.5, True, None, None, "/5"),
    ]
    c = lambda post, i, body, author, t, s: (post, f"c{i}", body, author, t, s, "/c")
    comments = [
        c("p1", 1, "Great final! OG great?", "bob", DAY + timedelta(hours=36), 10),
        c("p1", 2, "the and of", "bob", DAY, 9),
        c("p1", 3, "nice", "[deleted]", DAY, 8),
        c("p1", 4, " \t", "bob", DAY, 7),
        c("p1", 5, "T1 awful", None, DAY - timedelta(days=2), 6),
        c("p1", 5, "T1 awful", None, DAY - timedelta(days=2), 6),
        c("p2", 6, "later zed", "amy", DAY + timedelta(days=40), 1),
        c("p2", 7, "no time", "amy", None, 1),
        c("p3", 8, "not in the window", "amy", DAY, 1),
        c("p4", 9, "no query word", "amy", DAY, 1),
    ]
    events = event_dimension(spark, [EventWindow("A", DAY, DAY + timedelta(days=2), "og"), EventWindow("B", DAY, DAY + timedelta(days=2), "OG wins")])
    return spark.createDataFrame(posts, POSTS), spark.createDataFrame(comments, COMMENTS), events


def test_feature_table(spark):
    table = prepare.prepare(*threads_of(spark), WORDS)
    assert table.schema.names == PROCESSED.names and len(table.columns) == 41
    rows = {(r["event_name"], r["comment_id"]): r for r in table.collect()}
    assert set(rows) == {("A", "c1"), ("A", "c5"), ("A", "c6"), ("B", "c1"), ("B", "c5")}
    one = rows["A", "c1"]
    assert one["processed_comment_body"] == "great final og great"
    assert one["compound_sentiment"] == round(6 / (36 + 15) ** 0.5, 4)
    assert (one["time_period"], one["days_from_event_start"]) == ("During Event", 1)
    assert (one["contains_question"], one["contains_team_name"], one["contains_event_keyword"], one["contains_player_keyword"]) == (True, True, True, False)
    assert (one["post_type"], one["word_count"], one["char_count"], one["author_karma"]) == ("Tournament Result", 4, 22, 0)
    assert one["comment_to_post_score_ratio"] == 10 / 51 and one["comment_score_per_day"] == pytest.approx(10 / 1.5)
    assert (one["comment_hour"], one["comment_day_of_week"]) == (12, "Thursday")
    # the digit is gone from the processed text, but teams are looked up in the raw body
    assert rows["A", "c5"]["contains_team_name"] and rows["A", "c5"]["processed_comment_body"] == "awful"
    assert rows["A", "c5"]["time_period"] == "Before Event" and rows["A", "c5"]["comment_score_per_day"] == 6.0
    assert rows["A", "c6"]["time_period"] == "Outside Window" and rows["A", "c6"]["contains_player_keyword"]


def test_limits_and_listing(spark):
    posts, comments, events = threads_of(spark)
    raw = threads.collect_threads(posts, comments, events, max_posts=1, comment_limit=2)
    assert sorted((r["event_name"], r["comment_id"]) for r in raw.collect()) == [("A", "c1"), ("A", "c2"), ("B", "c1"), ("B", "c2")]
    # the listing brings in posts without the query words
    raw = threads.collect_threads(posts, comments, events, listing_since=DAY - timedelta(days=100))
    assert {r["post_id"] for r in raw.collect()} == {"p1", "p2", "p4"}


def test_audit(spark):
    posts, comments, events = threads_of(spark)
    raw = threads.collect_threads(posts, comments, events.where("event_name = 'A'"))
    steps = [(r["step"], r["rows_in"], r["rows_out"]) for r in prepare.audit(raw, WORDS).orderBy("step_no").collect()]
    assert steps == [("duplicate comment", 8, 7), ("blank body", 7, 6), ("deleted author", 6, 5), ("empty processed body", 5, 4)]


def test_landed_rows_give_the_same_table(spark, tmp_path):
    posts, comments, events = threads_of(spark)
    raw = threads.collect_threads(posts, comments, events).select("event_name", *RAW.names)
    tables.write_raw(raw, str(tmp_path / "raw"))
    landed = tables.read_raw(spark, str(tmp_path / "raw"), raw.schema).drop("source_file")
    direct = prepare.prepare(posts, comments, events, WORDS)
    assert sorted(map(str, prepare.prepare_landed(landed, events, WORDS).collect())) == sorted(map(str, direct.collect()))


def test_row_features_run_on_a_stream(spark, tmp_path):
    posts, comments, events = threads_of(spark)
    raw = threads.collect_threads(posts, comments, events).select("event_name", "start_ts", "end_ts", "pre_start_ts", "post_end_ts", *RAW.names)
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    out = prepare.enrich(prepare.add_processed_text(stream, WORDS), WORDS)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    want = prepare.enrich(prepare.add_processed_text(spark.read.schema(raw.schema).parquet(str(tmp_path / "in")), WORDS), WORDS)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect()))


def many_rows(spark, n=300):
    """A processed table with a score that the word count explains."""
    row = prepare.prepare(*threads_of(spark), WORDS).where("comment_id = 'c1' and event_name = 'A'")
    i = F.col("i")
    return row.crossJoin(spark.range(n).withColumnRenamed("id", "i")).withColumns({
        "comment_id": F.concat(F.lit("c"), i.cast("string")),
        "event_name": F.element_at(F.array(*[F.lit(e) for e in "ABCD"]), (i % 4 + 1).cast("int")),
        "time_period": F.when(i % 5 == 0, "Before Event").otherwise("During Event"),
        "post_type": F.when(i % 3 == 0, "Other").otherwise("Ranking Update"),
        "word_count": (i * 7 % 50).cast("int"), "contains_question": i % 2 == 0, "contains_team_name": i % 7 == 0,
        "compound_sentiment": F.sin(i.cast("double")), "comment_score": (i * 7 % 50) * 3 + i % 2,
        "processed_comment_body": F.concat_ws(" ", F.lit("word"), F.when(i % 2 == 0, "even").otherwise("odd")),
    }).drop("i")


def test_report_and_battery(spark):
    df = many_rows(spark)
    out = report.report(df)
    for name in ("dist_comment_score_summary", "dist_word_count_kde_curve", "time_periods_table", "pearson_correlation",
                 "avg_compound_sentiment_by_time_period_and_event", "word_count_by_selected_post_types", "comment_score_by_weekday"):
        assert name in out
    assert len(out) == 32
    assert out["dist_comment_score_summary"].first()["count"] == 300
    assert sum(r["count"] for r in out["time_periods_counts"].collect()) == 300
    few = report.report(df.select("event_name", "word_count", "time_period").limit(20))
    assert "time_periods_table" in few and "comment_score_by_weekday" not in few and "dist_comment_score_summary" not in few
    tests = report.run_battery(df, report.standard_battery(["A", "B", "C", "D"])).orderBy("test_no").collect()
    assert [t["test"] for t in tests] == ["t_test"] * 4 + ["anova"] * 4 + ["chi2"] * 2
    assert all(t["status"] == "completed" for t in tests)


def test_training(spark):
    df = many_rows(spark, 200)
    done = train.train(
        df, "comment_id", ["event_name", "comment_id"], draws=2, cv_folds=2, search_folds=2, boosted_params={"maxIter": 3, "maxDepth": 3},
        search_space={**models.SEARCH_SPACE, "maxIter": ("int", 2, 4), "maxDepth": ("int", 2, 4)},
    )
    assert done.leaking == [] and not any("per_day" in n for n in done.names)
    assert done.metrics["linear"]["r2_test"] > 0.95 and done.metrics["boosted_tuned"]["r2_test"] > 0.5
    assert sum(r["importance"] for r in done.importance.collect()) == pytest.approx(1.0)
    totals = done.attribution.groupBy("comment_id").agg(F.sum("shap").alias("s")).join(done.test, "comment_id")
    assert totals.count() == 40
    assert totals.where(F.abs(F.col("s") + done.base_value - F.col("prediction")) > 1e-6).count() == 0


def test_events_with_the_same_words_share_one_search(spark, monkeypatch):
    posts = spark.createDataFrame([(f"p{i}", DAY, i, "red car", "") for i in range(6)], "post_id string, post_created_utc timestamp, post_score int, post_title string, selftext string")
    comments = spark.createDataFrame([(f"p{i}", f"c{i}", DAY, 1) for i in range(6)], "post_id string, comment_id string, comment_created_utc timestamp, comment_score int")
    windows = event_dimension(spark, [EventWindow(n, DAY - timedelta(days=k), DAY + timedelta(days=k), q) for n, k, q in (("A", 1, "car"), ("B", 2, "car"), ("C", 3, "bus"))])
    paired, plain = [], threads.pair_with_events
    monkeypatch.setattr(threads, "pair_with_events", lambda df, events, *a: paired.append(events.count()) or plain(df, events, *a))
    got = threads.collect_threads(posts, comments, windows, post_limit=4, max_posts=3)
    assert paired == [2]
    assert {(r.event_name, r.post_id) for r in got.collect()} == {(e, f"p{i}") for e in "AB" for i in (3, 4, 5)}


def test_texts_that_all_events_share_are_processed_once(spark, tmp_path):
    posts, comments, _ = threads_of(spark)
    path = str(tmp_path / "raw")  # a table, since the optimizer evaluates local rows itself
    joined = posts.join(comments, "post_id").select(*[f.name for f in RAW.fields])
    joined.unionAll(joined).write.parquet(path)
    raw = spark.read.schema(RAW).parquet(path)
    events = event_dimension(spark, [EventWindow("E1", DAY, DAY + timedelta(days=2)), EventWindow("E2", DAY + timedelta(days=1), DAY + timedelta(days=3))])
    paired = threads.pair_with_events(raw, events)
    shared = prepare.enrich(prepare.clean_shared(raw, WORDS), WORDS, events)
    each = prepare.enrich(prepare.clean(paired, WORDS), WORDS)
    assert shared.count() > 0 and shared.exceptAll(each).isEmpty() and each.exceptAll(shared).isEmpty()
    audits = [sorted(a.collect()) for a in (prepare.audit(raw, WORDS, events), prepare.audit(paired, WORDS))]
    assert audits[0] == audits[1]
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_name" not in plan  # a text is shuffled once, not once an event


def test_many_windows_are_dealt_over_all_tasks(spark):
    rows = spark.range(3000).select("id", F.timestamp_seconds(F.col("id") * 40).alias("at"))
    length = F.when(F.col("id") % 50 == 0, 20000).when(F.col("id") % 7 == 0, 0).otherwise(1800)
    windows = rows.where("id % 3 = 0").select(
        F.col("id").alias("window"), F.col("at").alias("start_ts"), F.timestamp_seconds(F.col("id") * 40 + length).alias("end_ts"), F.lit("").alias("query")
    )
    got = threads.assign_events(rows, "at", windows).select("window", "id")
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    sizes = {w: 20000 if w % 50 == 0 else 0 if w % 7 == 0 else 1800 for w in range(0, 3000, 3)}
    assert sorted(map(tuple, got.collect())) == [(w, i) for w in sizes for i in range(w, min(3000, w + sizes[w] // 40 + 1))]
