"""Declared schemas and column roles."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels of the four periods, in report order.
PERIODS = ["Before Event", "During Event", "After Event", "Outside Window"]
# Weekday names, in report order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Fixed value: marker of a deleted author.
DELETED_AUTHOR = "[deleted]"

# Names and types of the fields of posts, comments and derived features.
POST_FIELDS = [
    T.StructField("post_id", T.StringType()),
    T.StructField("post_title", T.StringType()),
    T.StructField("post_url", T.StringType()),
    T.StructField("post_author", T.StringType()),
    T.StructField("post_created_utc", T.TimestampType()),
    T.StructField("post_score", T.LongType()),
    T.StructField("post_num_comments", T.LongType()),
    T.StructField("upvote_ratio", T.DoubleType()),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("link_flair_text", T.StringType()),
    T.StructField("permalink", T.StringType()),
]
COMMENT_FIELDS = [
    T.StructField("comment_id", T.StringType()),
    T.StructField("comment_body", T.StringType()),
    T.StructField("comment_author", T.StringType()),
    T.StructField("comment_created_utc", T.TimestampType()),
    T.StructField("comment_score", T.LongType()),
    T.StructField("comment_permalink", T.StringType()),
]
POSTS = T.StructType(POST_FIELDS)
COMMENTS = T.StructType([T.StructField("post_id", T.StringType()), *COMMENT_FIELDS])
RAW = T.StructType([*POST_FIELDS, *COMMENT_FIELDS])

EVENTS = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("start_ts", T.TimestampType()),
        T.StructField("end_ts", T.TimestampType()),
        T.StructField("pre_start_ts", T.TimestampType()),
        T.StructField("post_end_ts", T.TimestampType()),
    ]
)

DERIVED_FIELDS = [
    T.StructField("processed_comment_body", T.StringType()),
    T.StructField("neg_sentiment", T.DoubleType()),
    T.StructField("neu_sentiment", T.DoubleType()),
    T.StructField("pos_sentiment", T.DoubleType()),
    T.StructField("compound_sentiment", T.DoubleType()),
    T.StructField("char_count", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("time_period", T.StringType()),
    T.StructField("days_from_event_start", T.LongType()),
    T.StructField("post_title_length", T.IntegerType()),
    T.StructField("post_title_word_count", T.IntegerType()),
    T.StructField("contains_question", T.BooleanType()),
    T.StructField("author_karma", T.IntegerType()),
    T.StructField("contains_team_name", T.BooleanType()),
    T.StructField("contains_player_keyword", T.BooleanType()),
    T.StructField("contains_hero_keyword", T.BooleanType()),
    T.StructField("contains_event_keyword", T.BooleanType()),
    T.StructField("post_type", T.StringType()),
    T.StructField("comment_to_post_score_ratio", T.DoubleType()),
    T.StructField("comment_score_per_day", T.DoubleType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("comment_hour", T.IntegerType()),
    T.StructField("comment_day_of_week", T.StringType()),
]
PROCESSED = T.StructType([*RAW.fields, *DERIVED_FIELDS])

# Roles of the columns in the models.
CATEGORICAL = ["time_period", "comment_day_of_week", "event_name", "link_flair_text", "post_type"]
NUMERICAL = [
    "compound_sentiment", "char_count", "word_count", "days_from_event_start", "comment_hour",
    "author_karma", "comment_score_per_day", "post_score", "post_num_comments", "upvote_ratio",
    "post_title_length", "post_title_word_count", "neg_sentiment", "neu_sentiment", "pos_sentiment",
]
BOOLEAN = [
    "contains_question", "contains_team_name", "contains_player_keyword", "contains_hero_keyword",
    "contains_event_keyword", "is_self",
]
TEXT = "processed_comment_body"
TARGET = "comment_score"
# Columns computed from the target; a model must not see them (they leak the answer).
TARGET_DERIVED = ["comment_score_per_day", "comment_to_post_score_ratio"]
