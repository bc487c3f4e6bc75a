"""Collecting threads: search, listings, event windows, top posts and their comments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadtide.functions.temporal import instant
from threadtide.operators import bounded

POST_LIMIT = 1000
MAX_POSTS = 15
COMMENT_LIMIT = 50
# Up to this many event windows are carried in the plan as a literal array.
MAX_INLINE_EVENTS = 256
# Windows by length: the shortest class, how much longer each next one may be, and the time buckets of its longest window.
MIN_WINDOW_SECONDS = 60
WINDOW_STEP = 4
WINDOW_PARTS = 16


def matches_query(query: Column | str, *texts: Column) -> Column:
    """Every word of the query occurs in the texts, whatever the case."""
    haystack = F.lower(F.concat_ws(" ", *texts))
    words = F.filter(F.split(F.lower(F.lit(query) if isinstance(query, str) else query), r"\s+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(haystack, w))


def search_posts(posts: DataFrame, query: str, texts: Sequence[str], score: str, key: str, limit: int = POST_LIMIT) -> DataFrame:
    """Best-scored posts that hold every query word."""
    hits = posts.where(matches_query(query, *[F.col(t) for t in texts]))
    return hits.orderBy(F.desc(score), key).limit(limit)


def top_since(posts: DataFrame, created: str, since, score: str, key: str, limit: int = POST_LIMIT) -> DataFrame:
    """Best-scored posts created after an instant, no text match."""
    return posts.where(F.col(created) > instant(since)).orderBy(F.desc(score), key).limit(limit)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by a total order. Spark prunes to one row per key and partition
    before the shuffle (WindowGroupLimit), so many copies of one key do not pile up in a task."""
    return top_n(df, keys, order, 1)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows per key by a total order, pruned on the map side."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def merge_listings(listings: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Bag union of listings, one row per key; the later listing wins."""
    ranked = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(listings)]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df)
    return first_per_key(union, keys, [F.desc("_source")]).drop("_source")


def _literal(events: DataFrame, rows: list[dict]) -> Column:
    """Event rows as one literal array of structs; no rows give an empty array of the same type."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    if not rows:
        fields = ", ".join(f"`{name}`: {kind.simpleString()}" for name, kind in kinds.items())
        return F.array().cast(f"array<struct<{fields}>>")

    def literal(name: str, value) -> Column:
        typed = F.timestamp_micros(F.lit(value)) if kinds[name].typeName() == "timestamp" else F.lit(value).cast(kinds[name])
        return typed.alias(name)

    return F.array(*[F.struct(*[literal(k, v) for k, v in row.items()]) for row in rows])


def _plain(events: DataFrame) -> DataFrame:
    ts = [f.name for f in events.schema.fields if f.dataType.typeName() == "timestamp"]
    return events.select(*[F.unix_micros(c).alias(c) if c in ts else c for c in events.columns])


def _inline_events(events: DataFrame) -> Column | None:
    """The event rows as a literal, or None if there are too many."""
    rows = _plain(events).limit(MAX_INLINE_EVENTS + 1).toArrow().to_pylist()
    return None if len(rows) > MAX_INLINE_EVENTS else _literal(events, rows)


def _event_blocks(events: DataFrame) -> list[Column]:
    """The event rows as literals of about MAX_INLINE_EVENTS rows; they reach the driver block by block."""
    inline = _inline_events(events)
    if inline is not None:
        return [inline]
    blocks = -(-2 * events.count() // MAX_INLINE_EVENTS)
    plain = _plain(events).withColumn("_block", F.pmod(F.xxhash64(*events.columns), F.lit(blocks)))
    parts = [plain.where(F.col("_block") == k).drop("_block").toArrow().to_pylist() for k in range(blocks)]
    return [_literal(events, rows) for rows in parts if rows]


def _pair(df: DataFrame, inline: Column, when: Callable[[Column], Column] | None) -> DataFrame:
    return df.select("*", F.inline(F.filter(inline, when) if when else inline))


def assign_events(df: DataFrame, created: str, events: DataFrame, texts: Sequence[str] | None = None) -> DataFrame:
    """Pair each row with every event whose [start_ts, end_ts] holds its time (1:N).

    With ``texts`` the row must also hold the event's query words. A few events are a literal in
    the plan (map-only). Many events become an equi-join on time buckets: a window falls into the
    class of the next length that is as long as itself, whose buckets are a WINDOW_PARTS-th of that
    length, so it meets 17 or so at most, and a row meets one bucket of each class that occurs. The
    buckets are dealt over a fixed number of tasks, since the pairs, not the two sides' bytes, are the work.
    """
    at = F.col(created).cast("timestamp")
    match = (lambda q: matches_query(q, *[F.col(t) for t in texts])) if texts else (lambda q: F.lit(True))
    inline = _inline_events(events)
    if inline is not None:
        return _pair(df, inline, lambda e: at.between(e["start_ts"], e["end_ts"]) & match(e["query"]))
    seconds = F.unix_seconds("end_ts") - F.unix_seconds("start_ts") + 1
    steps = F.greatest(F.lit(0), F.ceil(F.log(float(WINDOW_STEP), seconds / MIN_WINDOW_SECONDS))).cast("int")
    width = lambda k: F.lit(MIN_WINDOW_SECONDS / WINDOW_PARTS) * F.pow(F.lit(float(WINDOW_STEP)), k)
    bucket = lambda t, k: F.floor(F.unix_seconds(t) / width(k))
    spans = events.where("start_ts <= end_ts").withColumn("_class", steps)
    classes = [r["_class"] for r in spans.select("_class").distinct().orderBy("_class").collect()]  # a few: widths grow by steps
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start_ts"), F.col("_class")), bucket(F.col("end_ts"), F.col("_class")))))
    spread = df.withColumn("_class", F.explode(F.array(*[F.lit(k) for k in classes]).cast("array<int>")))
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    dealt = lambda side: side.repartition(tasks, "_class", "_bucket")
    joined = dealt(spread.withColumn("_bucket", bucket(at, F.col("_class")))).join(dealt(spans), ["_class", "_bucket"])
    return joined.where(at.between(F.col("start_ts"), F.col("end_ts")) & match(F.col("query"))).drop("_class", "_bucket")


def pair_with_events(df: DataFrame, events: DataFrame, when: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every row with every event of a stated event table (for tables without an event key).

    ``when`` tests the event struct next to the row, before a pair is made. A large event table is
    paired in blocks, one pass over the rows for each.
    """
    blocks = [_pair(df, inline, when) for inline in _event_blocks(events)]
    out = blocks[0]
    for part in blocks[1:]:
        out = out.unionByName(part)
    return out


def attach_events(df: DataFrame, events: DataFrame, key: str = "event_name") -> DataFrame:
    """Event columns for rows that already carry the event's name."""
    return df.join(bounded.small_side(events), key)


def flatten_threads(posts: DataFrame, comments: DataFrame, key: str = "post_id", posts_are_few: bool = False) -> DataFrame:
    """Each comment with its post's columns; posts without comments vanish.

    posts_are_few: the posts were cut to the top n per event, so their count is bounded and is
    checked before a broadcast. Otherwise a plain equi-join, whose hot posts AQE splits.
    """
    side = bounded.small_side(posts) if posts_are_few else posts
    return comments.join(side, key)


def collect_threads(
    posts: DataFrame,
    comments: DataFrame,
    events: DataFrame,
    listing_since=None,
    post_limit: int = POST_LIMIT,
    max_posts: int = MAX_POSTS,
    comment_limit: int = COMMENT_LIMIT,
) -> DataFrame:
    """Raw comment rows of the best posts of every event, one plan for all events.

    Per event: posts holding the query words (best post_limit by score) plus the best posts since
    listing_since, created inside the window; of these the max_posts best by score; of each post
    the comment_limit best comments. A post may serve several events. The search knows no window, so
    events with the same words share one search, and posts are paired with distinct queries only.
    """
    best = [F.desc("post_score"), F.asc("post_id")]
    texts = ["post_title", "selftext"]
    queries = events.select("query").distinct()
    matched = pair_with_events(posts, queries, lambda e: matches_query(e["query"], *[F.col(t) for t in texts]))
    found = top_n(matched, ["query"], best, post_limit)
    listings = [found.join(bounded.small_side(events), "query").select(*posts.columns, *events.columns)]
    if listing_since is not None:
        recent = top_since(posts, "post_created_utc", listing_since, "post_score", "post_id", post_limit)
        listings.append(pair_with_events(recent, events))
    inside = [df.where(F.col("post_created_utc").between(F.col("start_ts"), F.col("end_ts"))) for df in listings]
    unique = merge_listings(inside, ["event_name", "post_id"])
    chosen = top_n(unique, ["event_name"], best, max_posts)
    threads = flatten_threads(chosen, comments, posts_are_few=True)
    order = [F.desc("comment_score"), F.asc("comment_id"), F.asc("comment_created_utc")]
    return top_n(threads, ["event_name", "post_id"], order, comment_limit)


def keyword_rows(df: DataFrame, row_id: str, text: str, dictionary: DataFrame, keyword: str = "keyword") -> DataFrame:
    """Ids of rows whose lower-cased text holds an entry of a dictionary table as a whole word.

    For dictionaries too large for a plan literal, with the same answers as ``contains_word``. A
    text can only hold an entry if the entry's first word is one of the text's words (or, if the
    entry has no word, its marks stand between two words), so that part is the join key; the
    candidates are then tested between word boundaries.
    """
    lowered = F.lower(F.col(text))
    entries = dictionary.select(F.lower(keyword).alias("_entry")).where("_entry <> ''").distinct()
    first = F.regexp_extract("_entry", r"(?U)\w+", 0)
    keyed = entries.select("_entry", F.when(first == "", F.col("_entry")).otherwise(first).alias("_key"), (first == F.col("_entry")).alias("_whole"))
    parts = F.array_distinct(F.concat(F.split(lowered, r"(?U)\W+"), F.split(lowered, r"(?U)\w+")))
    found = df.select(row_id, F.explode(parts).alias("_key"))
    plain, odd = keyed.where("_whole").select("_key").distinct(), keyed.where("not _whole").select("_key", "_entry")
    whole = found.join(bounded.small_side(plain), "_key", "left_semi").select(row_id)
    if odd.isEmpty():
        return whole.distinct()
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace("_entry", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    candidates = found.join(bounded.small_side(odd), "_key").select(row_id, "_entry").distinct()
    texts = df.select(row_id, lowered.alias("_text"))
    tested = texts.join(candidates, row_id).where(F.regexp_like("_text", quoted)).select(row_id)
    return whole.unionByName(tested).distinct()
