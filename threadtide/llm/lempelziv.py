"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases, each the longest known phrase plus one character. The phrases are hashed
as a set; the SLOTS least hashes are the fingerprint, and two fingerprints estimate the share of common
phrases, which is large where one text would compress well with the other's dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from threadtide.llm import textkit
from threadtide.llm.shared import partitions

SLOTS = 128
#: Ranges of ids per shuffle partition; their heads (one row each) are the only rows that are sent twice.
RANGES = 4
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def phrases(text: str, at: int, seen: set[str]) -> list[str]:
    """New phrases of text[at:], given the phrases known so far (all their beginnings are known too); adds them to `seen`."""
    out, n, guess = [], len(text), 1
    add, push = seen.add, out.append
    while at < n:
        k = min(guess, n - at)
        phrase = text[at : at + k]
        if phrase in seen:
            while phrase in seen and at + k < n:
                k += 1
                phrase = text[at : at + k]
            if phrase in seen:
                break  # the text ends within a known phrase
        else:
            while k > 1:
                shorter = text[at : at + k - 1]
                if shorter in seen:
                    break
                k, phrase = k - 1, shorter
        add(phrase)
        push(phrase)
        at += k
        guess = k
    return out


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))) for b in (_BASE, _INVERSE))
        return self.up, self.down


def phrase_hashes(joined: str, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """32-bit hashes of consecutive phrases of a text (first `ends[-1]` characters)."""
    if not len(ends):
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)[: ends[-1]]
    up, down = powers.to(len(codes) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], starts)
        return (textkit.mix64(sums * down[starts]) >> np.uint64(32)).astype(np.uint32)


def least(hashes: np.ndarray) -> np.ndarray:
    """The SLOTS least distinct hashes, in order."""
    found = np.unique(hashes)
    return found[:SLOTS]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases: among the SLOTS least hashes of both, those that both have. Two empty sets are alike."""
    union = np.union1d(a, b)[:SLOTS]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b)).sum() / len(union))


def fingerprint(slots: np.ndarray) -> str:
    """Slots as text: eight hex digits each."""
    return slots.astype(">u4").tobytes().hex()


def slots_of(fingerprint_: str) -> np.ndarray:
    """Slots back from a fingerprint."""
    return np.frombuffer(bytes.fromhex(fingerprint_), ">u4").astype(np.uint32)


class Parsed:
    """A text with its phrases, ready to be continued with other characters from any place."""

    def __init__(self, text: str, powers: _Powers):
        self.text, self.powers = text, powers
        self.phrases = phrases(text, 0, set())
        self.ends = np.cumsum([len(p) for p in self.phrases], dtype=np.int64)
        self.hashes = phrase_hashes(text, self.ends, powers)
        self.slots = least(self.hashes)

    def edited(self, cut: int, tail: str) -> tuple[str, np.ndarray]:
        """The text with all from `cut` replaced, and its slots; the parse up to there is taken over."""
        whole = self.text[:cut] + tail
        known = int(np.searchsorted(self.ends, cut, side="right"))
        start = int(self.ends[known - 1]) if known else 0
        new = phrases(whole, start, set(self.phrases[:known]))
        ends = np.cumsum([len(p) for p in new], dtype=np.int64)
        return whole, least(np.concatenate((self.hashes[:known], phrase_hashes(whole[start:], ends, self.powers))))


def edited_tail(parsed: Parsed, follower: str) -> tuple[int, str]:
    """Where the last third of a text begins, and the characters of the next text that take its place."""
    third = len(parsed.text) // 3
    return len(parsed.text) - third, follower[:third]


def in_order(frame: DataFrame) -> DataFrame:
    """(id, text, bucket, extra) in ranges of descending ids, each followed by the head of the next range.

    Ranges come from approximate quantiles, so they are even whatever the ids are; null ids come last, equal
    ids are ordered by their texts. The head of the first range follows the last one.
    """
    spark = frame.sparkSession
    place = F.coalesce(F.col("id").cast("double"), F.lit(-1e300))
    ids = frame.select(place.alias("place"))
    count = RANGES * partitions(spark)
    cuts = ids.agg(F.percentile_approx("place", [k / count for k in range(1, count)], 20 * count)).first()[0] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(frame.withColumn("place", place))
    dealt = dealt.withColumn("bucket", -F.col("bucket").cast("int"))
    heads = dealt.groupBy("bucket").agg(F.max("place").alias("head")).orderBy("bucket").collect()  # a row for each range
    # The head of a range also follows the range before it.
    follows = [(row.head, heads[k - 1].bucket) for k, row in enumerate(heads)]
    after = spark.createDataFrame(follows, "place double, target int")
    return (
        dealt.join(F.broadcast(after), "place", "left")
        .withColumn("to", F.explode(F.when(F.col("target").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")))).otherwise(
            F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra")), F.struct(F.col("target").alias("bucket"), F.lit(1).alias("extra")))
        )))
        .select("id", "text", "to.*", "place")
        .repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "extra", F.desc("place"), F.desc_nulls_last("id"), "text")
    )


def fingerprints(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses; one row per row.

    The edited text has its last third replaced by the beginning of the next document by descending key
    (the first one after the last; a single row follows itself). Null texts are empty and have an empty
    fingerprint; other columns are not read.
    """
    textkit.limit_batches(frame.sparkSession)
    kind = frame.schema[key].dataType.simpleString()
    rows = in_order(frame.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")))
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        held: tuple | None = None  # the row that waits for its successor: bucket, id, parsed text
        for batch in textkit.sliced(batches, 200):
            out = []
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            buckets, extras = batch.column("bucket").to_pylist(), batch.column("extra").to_pylist()
            for i, value in enumerate(texts):
                if extras[i] and held is None:
                    continue  # a further row with the head's id
                parsed = Parsed(value, powers)
                if held and held[0] == buckets[i]:
                    _, own, first = held
                    whole, slots = first.edited(*edited_tail(first, value))
                    out.append((own, len(first.text), hashlib.sha256(whole.encode()).hexdigest(), fingerprint(first.slots), fingerprint(slots),
                                likeness(first.slots, slots), likeness(first.slots, parsed.slots)))
                held = None if extras[i] else (buckets[i], ids[i].as_py(), parsed)
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), *(pa.array(c, t) for c, t in zip(columns[1:], types[1:]))], names)

    return rows.select("id", "text", "bucket", "extra").mapInArrow(
        run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
