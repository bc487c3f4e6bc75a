"""Text, time and number features over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadtide.functions import numeric, temporal, text
from threadtide.functions.lexicon import Lexicon, add_sentiment, add_sentiment_with_table
from threadtide.functions.text import STOP_WORDS
from threadtide.operators import substrings, threads
from threadtide.operators.lemmas import DETACHMENTS, lemmatize_with_dictionary, lemmatize_with_table
from threadtide.sources.events import event_dimension
from threadtide.sources.tables import spread
from workload import views
from workload.registry import query
from workload.views import EVENTS_SQL, LABELLED_SQL, rounded, table

# White space under Unicode rules, for the oracles' RE2 classes.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LETTER = r"\p{L}\p{M}\p{N}\p{Pc}"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_sql(column: str) -> str:
    """The cleaning steps as nested SQL calls."""
    x = f"lower({column})"
    x = f"regexp_replace({x}, '(http|www){NOT_WS}+', '', 'g')"
    x = f"regexp_replace({x}, '@[{LETTER}]+|#', '', 'g')"
    x = f"translate({x}, '{PUNCT}', '')"
    x = f"regexp_replace({x}, '\\p{{Nd}}+', '', 'g')"
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def word_sql(column: str, pattern: str) -> str:
    return f"regexp_matches(lower({column}), '(^|[^{LETTER}])({pattern})([^{LETTER}]|$)')"


TOKENS_SQL = f"""string_split(trim(regexp_replace(regexp_replace(regexp_replace({clean_sql('text')},
  '\\b(can|gim|gon|got|lem|wan)(not|me|na|ta)\\b', '\\1 \\2', 'g'), '[«“‘„»”’]', ' \\0 ', 'g'), ' +', ' ', 'g')), ' ')"""
LEMMA_SQL = """CASE WHEN length(t) < 4 OR regexp_matches(t, '(ss|us|is)$') THEN t
  WHEN regexp_matches(t, '[^aeiou]ies$') THEN regexp_replace(t, 'ies$', 'y')
  WHEN regexp_matches(t, '(s|x|z|ch|sh)es$') THEN regexp_replace(t, 'es$', '')
  WHEN regexp_matches(t, 's$') THEN regexp_replace(t, 's$', '') ELSE t END"""


def docs(spark, sf_dir, *columns):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


@query("t01_clean_text", f"SELECT doc_id, length({clean_sql('text')}) AS n, md5({clean_sql('text')}) AS digest FROM documents")
def _(spark, sf_dir):
    cleaned = docs(spark, sf_dir).select("doc_id", text.clean_text("text").alias("c"))
    return cleaned.select("doc_id", F.length("c").cast("bigint").alias("n"), F.md5("c").alias("digest"))


@query("t01_clean_urls", f"SELECT page_id, {clean_sql(chr(39) + 'see ' + chr(39) + ' || url || ' + chr(39) + ' now' + chr(39))} AS cleaned FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.concat(F.lit("see "), "url", F.lit(" now"))).alias("cleaned"))


@query("t02_preprocess_text", f"""SELECT doc_id, len(k) AS n_tokens, md5(array_to_string(k, ' ')) AS digest FROM (
  SELECT doc_id, list_transform(list_filter({TOKENS_SQL}, lambda t: t <> '' AND NOT list_contains({words_sql(STOP_WORDS)}, t)),
                                lambda t: {LEMMA_SQL}) AS k FROM documents)""")
def _(spark, sf_dir):
    done = docs(spark, sf_dir).select("doc_id", text.preprocess_text("text").alias("p"))
    return done.select("doc_id", text.word_count("p").cast("bigint").alias("n_tokens"), F.md5("p").alias("digest"))


@query("t02_lemma_table", """SELECT doc_id, array_to_string(list_transform(list_filter(string_split(lower(lang || ' ' || source || ' ' || lang), ' '),
  lambda t: t <> 'de'), lambda t: CASE t WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' ELSE t END), ' ') AS p FROM documents""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.concat_ws(" ", "lang", "source", "lang")).alias("x"))
    tokens = F.filter(F.split("x", " "), lambda t: ~t.isin(["de"]))
    lemmas = text.lemmatize(tokens, {"en": "english", "fr": "french"}, suffix_rules=False)
    return rows.select("doc_id", F.array_join(lemmas, " ").alias("p"))


@query("t02_lemma_join", f"""SELECT doc_id, md5(array_to_string(list_transform(string_split({clean_sql('text')}, ' '),
  lambda t: CASE t WHEN 'the' THEN 'THE' WHEN 'thing' THEN 'stuff' WHEN 'de' THEN 'of' ELSE t END), ' ')) AS digest FROM documents""")
def _(spark, sf_dir):
    lemmas = spark.createDataFrame([("the", "THE"), ("thing", "stuff"), ("de", "of"), ("de", "of")], "token string, lemma string")
    rows = docs(spark, sf_dir).withColumn("c", text.clean_text("text"))
    out = lemmatize_with_table(rows, "doc_id", F.split("c", " "), lemmas, "p")
    return out.select("doc_id", F.md5("p").alias("digest"))


LEXICON = Lexicon(
    {"worthless": -1.9, "stupid": -2.4, "thing": 1.2, "license": 0.4, "good": 1.9, "then": -0.3, "with": 0.6, "are": 0.9},
    boosters={"the": 1, "of": -1, "for": -1, "very": 1},
    negators=("and", "never", "that", "not"),
)
SENTIMENT_SQL = f"""WITH words AS (SELECT doc_id, list_filter(string_split({clean_sql('text')}, ' '), lambda t: length(t) > 1) AS w FROM documents),
  tokens AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words),
  lexicon(term, v) AS (VALUES {', '.join(f"('{t}', {v}::DOUBLE)" for t, v in LEXICON.valence.items())}),
  near AS (SELECT *, lag(t, 1) OVER q AS w1, lag(t, 2) OVER q AS w2, lag(t, 3) OVER q AS w3 FROM tokens WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
  v0 AS (SELECT near.*, v FROM near JOIN lexicon ON t = term),
  v1 AS (SELECT *, CASE WHEN w1 IS NULL OR w1 IN (SELECT term FROM lexicon) THEN v
    ELSE (v + 1.0 * 0.293 * CASE w1 WHEN 'the' THEN 1 WHEN 'very' THEN 1 WHEN 'of' THEN -1 WHEN 'for' THEN -1 ELSE 0 END * sign(v))
         * CASE WHEN w1 IN ('and', 'never', 'that', 'not') THEN -0.74 ELSE 1 END END AS a FROM v0),
  v2 AS (SELECT *, CASE WHEN w2 IS NULL OR w2 IN (SELECT term FROM lexicon) THEN a
    ELSE (a + 0.95 * 0.293 * CASE w2 WHEN 'the' THEN 1 WHEN 'very' THEN 1 WHEN 'of' THEN -1 WHEN 'for' THEN -1 ELSE 0 END * sign(a))
         * CASE WHEN w2 IN ('and', 'never', 'that', 'not') THEN -0.74 ELSE 1 END END AS b FROM v1),
  v3 AS (SELECT *, CASE WHEN w3 IS NULL OR w3 IN (SELECT term FROM lexicon) THEN b
    ELSE (b + 0.9 * 0.293 * CASE w3 WHEN 'the' THEN 1 WHEN 'very' THEN 1 WHEN 'of' THEN -1 WHEN 'for' THEN -1 ELSE 0 END * sign(b))
         * CASE WHEN w3 IN ('and', 'never', 'that', 'not') THEN -0.74 ELSE 1 END END * CASE WHEN w1 = 'least' THEN -0.74 ELSE 1 END AS s FROM v2),
  sums AS (SELECT doc_id, sum(s) AS s, sum(CASE WHEN s > 0 THEN s + 1 ELSE 0 END) AS p, sum(CASE WHEN s < 0 THEN 1 - s ELSE 0 END) AS n,
           count(*) FILTER (s <> 0) AS hits FROM v3 GROUP BY doc_id),
  shares AS (SELECT words.doc_id, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n, len(w) - coalesce(hits, 0) AS u FROM words LEFT JOIN sums USING (doc_id))
SELECT doc_id, CASE WHEN p + n + u > 0 THEN round(n / (p + n + u), 3) ELSE 0 END AS neg_sentiment,
  CASE WHEN p + n + u > 0 THEN round(u / (p + n + u), 3) ELSE 0 END AS neu_sentiment,
  CASE WHEN p + n + u > 0 THEN round(p / (p + n + u), 3) ELSE 0 END AS pos_sentiment,
  round(s / sqrt(s * s + 15), 4) AS compound_sentiment FROM shares"""


def _detached_sql(source: str, level: int) -> str:
    """The forms that the noun rules make of the column `form`."""
    made = ", ".join(f"CASE WHEN ends_with(form, '{end}') THEN left(form, length(form) - {len(end)}) || '{new}' END" for end, new in DETACHMENTS)
    return f"(SELECT w, f AS form, {level} AS level FROM (SELECT w, unnest([{made}]) AS f FROM {source}) WHERE f <> '')"


@query("t02_dictionary_lemmas", f"""WITH tokens AS (SELECT doc_id, unnest(string_split({clean_sql('text')}, ' ')) AS w, generate_subscripts(string_split({clean_sql('text')}, ' '), 1) AS pos FROM documents),
  dictionary AS (SELECT w FROM tokens GROUP BY w HAVING count(DISTINCT doc_id) > 1),
  d AS (SELECT DISTINCT w, w AS form FROM tokens), odd AS (SELECT * FROM d WHERE w = 'less'), r AS (SELECT * FROM d WHERE w <> 'less'),
  f1 AS {_detached_sql('r', 0)}, f2 AS {_detached_sql('f1', 1)}, f3 AS {_detached_sql('f2', 2)},
  forms AS (SELECT w, form, 0 AS level FROM d UNION ALL SELECT w, 'few', 0 FROM odd UNION ALL SELECT w, form, level FROM f1 UNION ALL SELECT w, form, level FROM f2 UNION ALL SELECT w, form, level FROM f3),
  best AS (SELECT w, arg_min(form, (level, length(form), form)) AS lemma FROM forms WHERE form IN (SELECT w FROM dictionary) GROUP BY w)
SELECT doc_id, md5(string_agg(coalesce(lemma, w), ' ' ORDER BY pos)) AS p FROM tokens LEFT JOIN best USING (w) GROUP BY doc_id""")
def _(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", text.clean_text("text").alias("c")))
    words = rows.select("doc_id", F.explode(F.split("c", " ")).alias("word")).distinct()
    dictionary = words.groupBy("word").count().where("count > 1")
    exceptions = spark.createDataFrame([("less", "few")], "token string, lemma string")
    out = lemmatize_with_dictionary(rows, "doc_id", F.split("c", " "), dictionary, "p", exceptions)
    return out.select("doc_id", F.md5("p").alias("p"))


@query("t03_lexicon_sentiment", SENTIMENT_SQL)
def _(spark, sf_dir):
    cleaned = docs(spark, sf_dir).select("doc_id", text.clean_text("text").alias("c"))
    return add_sentiment(cleaned, "c", LEXICON).drop("c")


@query("t03_large_lexicon", SENTIMENT_SQL)
def _(spark, sf_dir):
    # a lexicon beyond any literal: the table is joined
    filler = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("filler"), "l_orderkey", "l_linenumber").alias("term"), F.lit(1.0).alias("valence"))
    terms = spark.createDataFrame(list(LEXICON.valence.items()), "term string, valence double").unionAll(filler)
    cleaned = docs(spark, sf_dir).select("doc_id", text.clean_text("text").alias("c"))
    return add_sentiment_with_table(cleaned, "doc_id", "c", terms, boosters=LEXICON.boosters, negators=LEXICON.negators).drop("c")


@query("t04_text_length", f"""SELECT doc_id, length(text) AS char_count,
  len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda t: t <> '')) AS word_count FROM documents""")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", text.char_count("text").cast("bigint").alias("char_count"), text.word_count("text").cast("bigint").alias("word_count")
    )


@query("t05_whole_word", f"SELECT doc_id, {word_sql('text', 'then|thing|ou re')} AS found, FALSE AS no_list FROM documents")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id", text.contains_word("text", ["then", "thing", "ou re"]).alias("found"), text.contains_word("text", []).alias("no_list")
    )


LONG_LIST = [f"word{i}" for i in range(40)] + ["then", "thing", "worthless", "of the", "license"]


@query("t05_whole_word_long_list", f"SELECT doc_id, {word_sql('text', '|'.join(LONG_LIST))} AS found FROM documents")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.contains_word("text", LONG_LIST).alias("found"))


@query("t06_substring", "SELECT doc_id, contains(text, 'thin') OR contains(text, 'zz+') AS found FROM documents")
def _(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.contains_part(F.col("text"), ["thin", "zz+"]).alias("found"))


POST_TYPES = {"Transfer": ["license", "ß"], "Result": ["thing", "tion"], "Ranking": ["ment", "src1"]}
POST_TYPE_SQL = """CASE WHEN contains(x, 'license') OR contains(x, 'ß') THEN 'Transfer' WHEN contains(x, 'thing') OR contains(x, 'tion') THEN 'Result'
  WHEN contains(x, 'ment') OR contains(x, 'src1') THEN 'Ranking' ELSE 'Other' END"""


@query("t07_post_type", f"SELECT doc_id, {POST_TYPE_SQL} AS post_type FROM (SELECT doc_id, lower(text || ' ' || coalesce(nullif(source, 'src0'), '')) AS x FROM documents)")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), F.nullif("source", F.lit("src0")).alias("body"))
    return rows.select("doc_id", text.post_type("title", "body", POST_TYPES).alias("post_type"))


def _pieces_sql(places: int) -> str:
    """Six characters at each of some places of every document, as a table of patterns."""
    return f"(SELECT DISTINCT substr(text, 25 * k + 7, 6) AS pattern FROM documents, (SELECT unnest(range({places})) AS k) WHERE length(text) >= 25 * k + 12)"


def _pieces(rows, places: int):
    whole = rows.select("text", F.explode(F.array(*[F.lit(25 * k) for k in range(places)])).alias("k")).where(F.length("text") >= F.col("k") + 12)
    return whole.select(F.substring("text", F.col("k") + 7, F.lit(6)).alias("pattern")).distinct()


# about 20,000 patterns at sf0.01
@query("t06_pattern_table", f"""WITH p AS {_pieces_sql(28)}
SELECT doc_id, count(*) AS patterns, min(pattern) AS first_pattern FROM documents JOIN p ON contains(text, pattern) GROUP BY doc_id""")
def _(spark, sf_dir):
    rows = docs(spark, sf_dir)
    found = substrings.pattern_rows(rows, "doc_id", "text", _pieces(rows, 28))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("patterns"), F.min("pattern").alias("first_pattern"))


@query("t07_category_table", f"""WITH p AS (SELECT pattern, right(pattern, 1) AS category, -unicode(right(pattern, 1)) AS place FROM {_pieces_sql(6)}),
  best AS (SELECT doc_id, min(place) AS place FROM documents JOIN p ON contains(text, pattern) GROUP BY doc_id)
SELECT d.doc_id, coalesce(chr(-place), 'Other') AS post_type FROM documents d LEFT JOIN best USING (doc_id)""")
def _(spark, sf_dir):
    rows = docs(spark, sf_dir)
    last = F.right("pattern", F.lit(1))
    table_ = _pieces(rows, 6).select("pattern", last.alias("category"), (-F.ascii(last)).alias("place"))
    return substrings.first_category(rows.select("doc_id", "text"), "doc_id", "text", table_).select("doc_id", "post_type")


@query("t08_question_mark", "SELECT page_id, contains(url, '?') AS asks FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.contains_question("url").alias("asks"))


@query("t09_title_features", f"""SELECT doc_id, length(t) AS post_title_length, len(list_filter(regexp_split_to_array(t, '{WS}+'), lambda w: w <> '')) AS post_title_word_count
FROM (SELECT doc_id, text AS t FROM documents)""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return rows.select(
        "doc_id", text.char_count("t").cast("bigint").alias("post_title_length"), text.word_count("t").cast("bigint").alias("post_title_word_count")
    )


@query("t10_keyword_flags", f"""SELECT doc_id, {word_sql('text', 'then')} AS contains_team_name, {word_sql('p', 'thing')} AS contains_player_keyword,
  {word_sql('p', 'worthless|stupid')} AS contains_hero_keyword, {word_sql('p', 'license|web2')} AS contains_event_keyword
FROM (SELECT doc_id, text, {clean_sql('text')} AS p FROM documents)""")
def _(spark, sf_dir):
    rows = docs(spark, sf_dir).withColumn("p", text.clean_text("text"))
    return rows.select(
        "doc_id", text.contains_word("text", ["then"]).alias("contains_team_name"),
        text.contains_word("p", ["thing"]).alias("contains_player_keyword"),
        text.contains_word("p", ["worthless", "stupid"]).alias("contains_hero_keyword"),
        text.contains_word("p", ["license", "web2"]).alias("contains_event_keyword"),
    )


# --- time ----------------------------------------------------------------------------------------

STAMP = "'%Y-%m-%d %H:%M:%S'"


@query("x01_from_epoch", f"SELECT event_id, strftime(to_timestamp(user_id * 1000000 + event_id) AT TIME ZONE 'UTC', {STAMP}) AS t FROM events")
def _(spark, sf_dir):
    seconds = F.col("user_id") * 1000000 + F.col("event_id")
    return views.activity(spark, sf_dir).select("event_id", views.seconds_text(temporal.from_epoch(seconds)).alias("t"))


@query("x02_period_label", f"WITH {LABELLED_SQL} SELECT event_id, event_name, time_period FROM labelled")
def _(spark, sf_dir):
    return views.labelled(spark, sf_dir).select("event_id", "event_name", "time_period")


RAW_TIME_SQL = "CASE WHEN event_type = 'error' THEN 'garbage' WHEN event_type = 'click' THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END"


def _raw_time(spark, sf_dir):
    raw = F.when(F.col("event_type") == "error", "garbage").when(
        F.col("event_type") != "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    )
    return views.activity(spark, sf_dir).withColumn("raw", raw)


@query("x03_bad_timestamps", f"""WITH {EVENTS_SQL}, raw AS (SELECT event_id, {RAW_TIME_SQL} AS raw FROM events),
  parsed AS (SELECT *, try_cast(raw AS TIMESTAMP) AS ts FROM raw CROSS JOIN events_dim)
SELECT event_id, event_name, CASE WHEN raw IS NOT NULL AND ts IS NULL THEN 'Error: Invalid Timestamp Format'
  ELSE {views.PERIOD_SQL} END AS time_period FROM parsed""")
def _(spark, sf_dir):
    events = event_dimension(spark, views.ACTIVITY_EVENTS)
    rows = threads.pair_with_events(_raw_time(spark, sf_dir).select("event_id", "raw"), events)
    label = temporal.period_label_of_text("raw", "start_ts", "end_ts", "pre_start_ts", "post_end_ts")
    return rows.select("event_id", "event_name", label.alias("time_period"))


@query("x04_days_from_start", """SELECT l_orderkey * 10 + l_linenumber AS comment_id, l_suppkey,
  floor((epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1997-01-01 12:00:00')) / 86400000000)::BIGINT AS days_from_event_start FROM lineitem""")
def _(spark, sf_dir):
    start = F.to_timestamp(F.lit("1997-01-01 12:00:00"))
    return views.comments(spark, sf_dir).select("comment_id", "l_suppkey", temporal.days_from_start("comment_created_utc", start).alias("days_from_event_start"))


@query("x05_hour_of_day", "SELECT event_id, hour(ts)::BIGINT AS comment_hour FROM events")
def _(spark, sf_dir):
    return views.activity(spark, sf_dir).select("event_id", temporal.hour_of_day("ts").cast("bigint").alias("comment_hour"))


@query("x06_weekday_name", "SELECT event_id, dayname(ts) AS comment_day_of_week FROM events")
def _(spark, sf_dir):
    return views.activity(spark, sf_dir).select("event_id", temporal.weekday_name("ts").alias("comment_day_of_week"))


@query("x07_coerce_time", "SELECT event_id, hour(ts)::BIGINT AS comment_hour, dayname(ts) AS comment_day_of_week FROM events WHERE event_type NOT IN ('error', 'click')")
def _(spark, sf_dir):
    rows = temporal.add_time_features(_raw_time(spark, sf_dir).select("event_id", "raw"), "raw")
    return rows.select("event_id", F.col("comment_hour").cast("bigint").alias("comment_hour"), "comment_day_of_week")


@query("x08_zoned_text", f"SELECT event_id, strftime(ts - INTERVAL 150 MINUTE, {STAMP}) AS utc FROM events")
def _(spark, sf_dir):
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:30"))
    return views.activity(spark, sf_dir).select("event_id", views.seconds_text(temporal.parse_timestamp(zoned)).alias("utc"))


# --- numbers -------------------------------------------------------------------------------------

@query("m01_score_per_day", """SELECT l_orderkey * 10 + l_linenumber AS comment_id, l_suppkey, CASE WHEN l_shipdate > o_orderdate
  THEN l_extendedprice / ((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000::DOUBLE) ELSE l_extendedprice END AS comment_score_per_day
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, sf_dir):
    rate = numeric.score_per_day("comment_score", "comment_created_utc", "post_created_utc")
    return views.threaded(spark, sf_dir).select("comment_id", "l_suppkey", rate.alias("comment_score_per_day"))


@query("m02_score_ratio", """SELECT l_orderkey * 10 + l_linenumber AS comment_id, l_suppkey, CASE WHEN ps <> 0 THEN CASE WHEN ps <> -1 THEN l_extendedprice / (ps + 1) END
  ELSE l_extendedprice END AS ratio
FROM lineitem JOIN (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN -1 ELSE o_totalprice END AS ps FROM orders) ON l_orderkey = o_orderkey""")
def _(spark, sf_dir):
    parent = F.when(F.col("selftext") == "F", 0.0).when(F.col("selftext") == "O", -1.0).otherwise(F.col("post_score"))
    return views.threaded(spark, sf_dir).select("comment_id", "l_suppkey", numeric.score_ratio("comment_score", parent).alias("ratio"))


@query("m03_bounds", """SELECT event_type, round(avg(value) - stddev_samp(value), 6) AS lower_bound, round(avg(value) + stddev_samp(value), 6) AS upper_bound
FROM events GROUP BY event_type""")
def _(spark, sf_dir):
    from threadtide.operators.summary import with_bounds

    stats = views.activity(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return rounded(with_bounds(stats).select("event_type", "lower_bound", "upper_bound"))


@query("m04_finite", """SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1e10 WHEN 'view' THEN -1e10 WHEN 'signup' THEN NULL ELSE value END AS v FROM events""")
def _(spark, sf_dir):
    odd = (
        F.when(F.col("event_type") == "click", float("nan")).when(F.col("event_type") == "error", float("inf"))
        .when(F.col("event_type") == "view", float("-inf")).when(F.col("event_type") != "signup", F.col("value"))
    )
    return views.activity(spark, sf_dir).select("event_id", numeric.finite(odd).alias("v"))
