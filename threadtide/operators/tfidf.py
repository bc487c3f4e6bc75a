"""TF-IDF weights in long form (row, term, weight).

Spark lower-cases the texts and puts a space between their words; terms are then counted in Arrow batches, where a word is
the number of its place among the batch's distinct words. The texts are read again for each count, which costs less than
keeping a row for every row and term.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadtide.functions.text import STOP_WORDS
from threadtide.operators import bounded

MAX_FEATURES = 5000
MIN_DF = 5
MAX_DF = 0.8
#: Hash buckets of the first count, how many times more buckets than wanted terms a round looks into, and
#: occurrences up to which all terms are counted at once, since the summary would be no shorter.
BUCKETS, SPARE, PLAIN = 1 << 20, 4, 20_000_000
#: Text that is counted at once; a longer row is counted alone.
SLICE_BYTES = 8 << 20
VOCABULARY = "term string, df bigint, cf bigint"


def _spaced(text: Column) -> Column:
    """The lower-cased words with a space between them; null texts have none."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"(?U)\W+", " "), F.lit(""))


@dataclass
class Words:
    """Words of a slice: the distinct ones, and of each word in text order its number among them and its row."""

    distinct: pa.Array
    codes: np.ndarray
    rows: np.ndarray

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, second word (-1: none) and row of every word and of every two neighbours in a row."""
        pairs = np.flatnonzero(self.rows[1:] == self.rows[:-1])
        first, rows = (np.concatenate((v, v[pairs])) for v in (self.codes, self.rows))
        return first, np.concatenate((np.full(len(self.codes), -1), self.codes[pairs + 1])), rows

    def buckets(self, first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
        """A hash of each term that is the same in all tasks."""
        hashed = np.append(pd.util.hash_array(np.array(self.distinct.to_pylist(), object), categorize=False), np.uint64(0))
        with np.errstate(over="ignore"):
            mixed = hashed[first] * np.uint64(0x9E3779B97F4A7C15) + hashed[second]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            return (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)  # no division

    def spelled(self, first: np.ndarray, second: np.ndarray) -> pa.Array:
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        ends = pa.concat_arrays([pc.binary_join_element_wise(none, self.distinct, space), pa.array([""], pa.large_string())])
        second = pa.array(second % len(ends))  # -1: the empty end
        return pc.binary_join_element_wise(self.distinct.take(pa.array(first)), ends.take(second), none).cast(pa.string())


def words(spaced: pa.Array, stop_words: Sequence[str] = STOP_WORDS) -> Words:
    """Words of two and more characters without stop words, of texts with a space between words."""
    spaced = spaced.cast(pa.large_string())
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    held = data != 32
    starts = held.copy()
    starts[1:] &= ~held[:-1]
    starts[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(starts & held)
    edges = np.append(np.append(0, np.cumsum(held))[starts], np.count_nonzero(held)).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data[held])])
    coded = spans.dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_string())
    kept = pc.greater(pc.utf8_length(distinct), 1).to_numpy(zero_copy_only=False) & ~pc.is_in(
        distinct, pa.array(list(stop_words), pa.large_string())
    ).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    here = kept[codes]
    rows = np.searchsorted(offsets, starts[here], "right") - 1
    return Words(distinct.filter(pa.array(kept)), (np.cumsum(kept) - 1)[codes[here]], rows)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE_BYTES of text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = np.unique(np.concatenate(([0], np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1, [batch.num_rows])))
        for low, high in zip(edges[:-1], edges[1:]):
            yield batch.slice(low, high - low)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and how often each occurs."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[new], np.diff(np.append(new, len(keys)))


def _term_counts(texts: DataFrame, stop_words: Sequence[str], buckets: int = 1, asked: np.ndarray | None = None) -> DataFrame:
    """(term, tf) of every row and term or, if `asked` marks buckets, of every row and term of those."""
    marks = None if asked is None else texts.sparkSession.sparkContext.broadcast(asked)  # `buckets` bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found = words(batch.column("text"), stop_words)
            first, second, rows = found.grams()
            if marks is not None:
                here = marks.value[found.buckets(first, second, buckets)]
                first, second, rows = first[here], second[here], rows[here]
            term, place = np.unique((first << 32) | (second + 1), return_inverse=True)
            keys, tf = _runs(rows * max(1, len(term)) + place)
            spelled = found.spelled(term >> 32, (term & 0xFFFFFFFF) - 1)
            yield pa.RecordBatch.from_arrays([spelled.take(pa.array(keys % max(1, len(term)))), pa.array(tf)], ["term", "tf"])

    return texts.mapInArrow(count, "term string, tf bigint")


def _bucket_sums(texts: DataFrame, stop_words: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, total): occurrences of all terms by their hash."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in _sliced(batches):
            found = words(batch.column("text"), stop_words)
            first, second, _ = found.grams()
            sums += np.bincount(found.buckets(first, second, buckets), minlength=buckets)
        filled = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(sums[filled])], ["bucket", "total"])

    return texts.mapInArrow(add, "bucket int, total bigint").groupBy("bucket").agg(F.sum("total").alias("total"))


def vocabulary(
    df: DataFrame, row_id: str, text: str, stop_words: Sequence[str] = STOP_WORDS,
    max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF, buckets: int = BUCKETS, plain: int = PLAIN,
) -> DataFrame:
    """(term, df, cf, idf) of at most max_features terms: most frequent first, ties by term.

    `buckets` and `plain` choose the way of `_candidates` and do not change the result.
    """
    texts = df.select(_spaced(F.col(text)).alias("text"))
    return _vocabulary(texts, _term_counts(texts, stop_words), stop_words, max_features, min_df, max_df, buckets, plain)


def _vocabulary(
    texts: DataFrame, counts: DataFrame, stop_words: Sequence[str], max_features: int, min_df: int, max_df: float,
    buckets: int = BUCKETS, plain: int = PLAIN,
) -> DataFrame:
    rows = texts.count()
    found = _candidates(texts, counts, stop_words, max_features, min_df, max_df * rows, buckets, plain)
    return texts.sparkSession.createDataFrame(found.toArrow(), VOCABULARY).withColumn("idf", F.log((1 + rows) / (1 + F.col("df"))) + 1)


def _candidates(
    texts: DataFrame, counts: DataFrame, stop_words: Sequence[str], max_features: int, min_df: int, most: float, buckets: int, plain: int,
) -> DataFrame:
    """(term, df, cf) of the max_features most frequent terms that stand in min_df to `most` rows.

    First the occurrences are summed by the term's hash: a bucket's sum is no less than the frequency of any
    of its terms, and tasks shuffle `buckets` short rows at most, however many terms there are. Then only terms of
    buckets with a sum of at least `floor` are counted. If max_features of these reach the floor, no other term can
    be among them; else the floor falls until they do, or every term has been counted. Up to `plain` occurrences all
    terms are counted at once.
    """
    spark = texts.sparkSession

    def exact(asked: DataFrame) -> DataFrame:
        counted = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        eligible = counted.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(most)))
        found = eligible.orderBy(F.desc("cf"), "term").limit(max_features)
        return spark.createDataFrame(found.toArrow(), VOCABULARY)  # max_features rows at most

    sums = _bucket_sums(texts, stop_words, buckets).persist(StorageLevel.MEMORY_AND_DISK)
    rank = SPARE * max_features
    try:
        if (sums.agg(F.sum("total")).first()[0] or 0) <= plain:
            return exact(counts)
        while rank < buckets:
            ranked = sums.orderBy(F.desc("total")).limit(rank).agg(F.min("total").alias("floor"), F.count(F.lit(1)).alias("n")).first()
            if ranked["n"] < rank or ranked["floor"] <= min_df:
                break
            asked = np.zeros(buckets, bool)
            asked[sums.where(F.col("total") >= ranked["floor"]).select("bucket").toArrow()["bucket"].to_numpy()] = True  # `buckets` numbers at most
            found = exact(_term_counts(texts, stop_words, buckets, asked))
            if found.where(F.col("cf") >= ranked["floor"]).count() == max_features:
                return found
            rank *= SPARE
        return exact(counts)
    finally:
        sums.unpersist()


class Slots:
    """Places of vocabulary terms by their words."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        self.words = pa.array(sorted({w for t in split for w in t}), pa.large_string())
        place = {w: i for i, w in enumerate(self.words.to_pylist())}
        keys = np.array([(place[t[0]] << 32) | (place[t[1]] + 1 if len(t) > 1 else 0) for t in split], np.int64)
        self.places = np.argsort(keys)
        self.keys = keys[self.places]

    def find(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of every occurrence of a vocabulary term."""
        known = np.append(pc.fill_null(pc.index_in(found.distinct, self.words), -2).to_numpy(zero_copy_only=False).astype(np.int64), -1)
        first, second, rows = found.grams()
        first, second = known[first], known[second]
        here = (first >= 0) & (second >= -1)
        keys, rows = (first[here] << 32) | (second[here] + 1), rows[here]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[at] == keys
        return rows[same], self.places[at[same]]


def tfidf(
    df: DataFrame, row_id: str, text: str, stop_words: Sequence[str] = STOP_WORDS,
    max_features: int = MAX_FEATURES, min_df: int = MIN_DF, max_df: float = MAX_DF,
) -> DataFrame:
    """L2-normalised weights; rows without a vocabulary term have none.

    The vocabulary holds at most max_features rows and goes to the tasks, which weigh a row's terms as they meet it; the one
    shuffle of the result carries each row's own weights to their norm, with a number for each term.
    """
    spark = df.sparkSession
    texts = df.select(F.col(row_id).alias("row"), _spaced(F.col(text)).alias("text"))
    only = texts.select("text")
    known = _vocabulary(only, _term_counts(only, stop_words), stop_words, max_features, min_df, max_df).select("term", "idf").toArrow()
    names = known["term"].to_pylist()
    shared = spark.sparkContext.broadcast((Slots(names), known["idf"].to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, idf = shared.value
        for batch in _sliced(batches):
            if not len(idf):
                continue
            rows, places = slots.find(words(batch.column("text"), stop_words))
            keys, tf = _runs((rows << 32) | places)
            row, slot = keys >> 32, keys & 0xFFFFFFFF
            weights = tf * idf[slot]
            at, sizes = _runs(row)
            edges = np.append(0, np.cumsum(sizes)).astype(np.int32)
            listed = [pa.ListArray.from_arrays(pa.array(edges), pa.array(v)) for v in (slot.astype(np.int32), weights)]
            squares = np.bincount(row, weights * weights, batch.num_rows)[at]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at)), pa.array(squares), *listed], ["row", "squares", "slots", "w"])

    schema = T.StructType([T.StructField("row", texts.schema["row"].dataType), *T.StructType.fromDDL("squares double, slots array<int>, w array<double>")])
    per_row = texts.mapInArrow(weigh, schema).groupBy("row").agg(
        F.sqrt(F.sum("squares")).alias("norm"), F.flatten(F.collect_list(F.arrays_zip("slots", "w"))).alias("t")
    )
    terms = spark.createDataFrame(list(enumerate(names)), "slots int, term string")
    long = per_row.select("row", "norm", F.inline("t")).join(F.broadcast(terms) if max_features <= bounded.MAX_ROWS else terms, "slots")
    return long.select(F.col("row").alias(row_id), "term", (F.col("w") / F.col("norm")).alias("weight"))
