"""Posts + comments + events -> the 41-column feature table, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from threadtide.functions import numeric, temporal, text
from threadtide.functions.lexicon import Lexicon, sentiment
from threadtide.operators import selection, threads
from threadtide.operators.summary import cleaning_audit
from threadtide.schema import DELETED_AUTHOR, PROCESSED


#: Row features that look at the event's window.
EVENT_FEATURES = ("time_period", "days_from_event_start")


@dataclass(frozen=True)
class Dictionaries:
    """The word lists of a run; all are the caller's."""

    lexicon: Lexicon
    teams: Sequence[str] = ()
    players: Sequence[str] = ()
    heroes: Sequence[str] = ()
    event_words: Sequence[str] = ()
    post_types: Mapping[str, Sequence[str]] = field(default_factory=dict)
    stop_words: Sequence[str] = tuple(text.STOP_WORDS)
    lemmas: Mapping[str, str] | None = None


def first_comments(raw: DataFrame) -> DataFrame:
    """One row per event and comment id: the best post's, then the earliest."""
    order = [F.desc("post_score"), F.asc("post_id"), F.asc_nulls_last("comment_created_utc"), F.asc("comment_body")]
    return threads.first_per_key(raw, ["event_name", "comment_id"], order)


def add_processed_text(df: DataFrame, words: Dictionaries, body: str = "comment_body", out: str = "processed_comment_body") -> DataFrame:
    """Add the processed text and drop rows where nothing is left.

    Generating the text from a filtered one-element array evaluates it once; a plain filter on a
    computed column would be pushed below it and run the whole chain twice.
    """
    processed = text.preprocess_text(body, words.stop_words, words.lemmas)
    return df.select("*", F.explode(F.filter(F.array(processed), lambda t: t != "")).alias(out))


def clean(raw: DataFrame, words: Dictionaries) -> DataFrame:
    """Unique, non-blank comments of known authors with something left after processing."""
    kept = selection.drop_blank(first_comments(raw), "comment_body")
    return add_processed_text(selection.drop_deleted(kept, "comment_author"), words)


def first_shared(raw: DataFrame) -> DataFrame:
    """`first_comments` of rows that name no event, since every event has them all: one row per comment id."""
    order = [F.desc("post_score"), F.asc("post_id"), F.asc_nulls_last("comment_created_utc"), F.asc("comment_body")]
    return threads.first_per_key(raw, ["comment_id"], order)


def clean_shared(raw: DataFrame, words: Dictionaries) -> DataFrame:
    """`clean` of rows that name no event: each text is processed once, however many events follow."""
    kept = selection.drop_blank(first_shared(raw), "comment_body")
    return add_processed_text(selection.drop_deleted(kept, "comment_author"), words)


def audit(raw: DataFrame, words: Dictionaries, events: DataFrame | None = None) -> DataFrame:
    """Rows in and out of every cleaning step.

    With ``events`` the raw rows name no event and count once for every event; each text is processed once.
    """
    unique = first_comments(raw) if events is None else first_shared(raw)
    steps = [
        ("blank body", ~text.is_blank("comment_body")),
        ("deleted author", ~F.col("comment_author").eqNullSafe(DELETED_AUTHOR)),
        ("empty processed body", text.preprocess_text("comment_body", words.stop_words, words.lemmas) != ""),
    ]
    rows_in = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    if events is not None:
        flags = [F.coalesce(keep, F.lit(False)).alias(f"_{i}") for i, (_, keep) in enumerate(steps)]
        unique = threads.pair_with_events(unique.select(*flags), events)
        steps = [(name, F.col(f"_{i}")) for i, (name, _) in enumerate(steps)]
        rows_in = rows_in * events.agg(F.count(F.lit(1))).scalar()
    return cleaning_audit(unique, steps, before=("duplicate comment", rows_in))


def row_features(words: Dictionaries) -> dict[str, Column]:
    """Every derived column that needs nothing but its own row (event windows attached)."""
    body, processed = F.col("comment_body"), F.col("processed_comment_body")
    return {
        "char_count": text.char_count(body),
        "word_count": text.word_count(body),
        "time_period": temporal.period_label("comment_created_utc", "start_ts", "end_ts", "pre_start_ts", "post_end_ts"),
        "days_from_event_start": temporal.days_from_start("comment_created_utc", "start_ts"),
        "post_title_length": text.char_count("post_title"),
        "post_title_word_count": text.word_count("post_title"),
        "contains_question": text.contains_question(body),
        "author_karma": F.lit(0),
        # teams are looked up in the raw body, the other lists in the processed one
        "contains_team_name": text.contains_word(body, words.teams),
        "contains_player_keyword": text.contains_word(processed, words.players),
        "contains_hero_keyword": text.contains_word(processed, words.heroes),
        "contains_event_keyword": text.contains_word(processed, words.event_words),
        "post_type": text.post_type("post_title", "selftext", words.post_types),
        "comment_to_post_score_ratio": numeric.score_ratio("comment_score", "post_score"),
        "comment_score_per_day": numeric.score_per_day("comment_score", "comment_created_utc", "post_created_utc"),
        "comment_hour": temporal.hour_of_day("comment_created_utc"),
        "comment_day_of_week": temporal.weekday_name("comment_created_utc"),
    }


def enrich(cleaned: DataFrame, words: Dictionaries, events: DataFrame | None = None) -> DataFrame:
    """Cleaned comments with event windows -> the processed schema. Works on streams unchanged.

    With ``events`` the comments name no event: what needs none is computed once per comment, before
    the comment is paired with every event.
    """
    scored = cleaned.withColumn("_score", sentiment(F.col("processed_comment_body"), words.lexicon))
    parts = {f"{p}_sentiment": F.col("_score")[p] for p in ("neg", "neu", "pos", "compound")}
    derived = {**parts, **row_features(words)}
    rows = scored.dropna(subset=["comment_created_utc"])
    if events is not None:
        own = {name: derived.pop(name) for name in list(derived) if name not in EVENT_FEATURES}
        rows = threads.pair_with_events(rows.withColumns(own), events)
    rows = rows.withColumns(derived)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PROCESSED.fields])


def prepare(posts: DataFrame, comments: DataFrame, events: DataFrame, words: Dictionaries, **limits) -> DataFrame:
    """The full feature table of all events."""
    raw = threads.collect_threads(posts, comments, events, **limits)
    return enrich(clean(raw, words), words)


def prepare_landed(raw: DataFrame, events: DataFrame, words: Dictionaries) -> DataFrame:
    """The feature table from landed raw rows that carry event_name."""
    return enrich(threads.attach_events(clean(raw, words), events), words)
