"""Toxicity scores: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Words count as they are and as stems of a few leading bytes, so that an inflected form that training
has not met still shares a feature with its relatives.

Training reads a bounded sample of the labelled rows in one task; the weights that the L1 term leaves
are at most 2**bits numbers and are broadcast to the tasks that score all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threadtide.llm import textkit

#: Training examples at most (in expectation: ids are chosen by a hash).
TRAIN_ROWS = 16_000
BITS = 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
#: Distances in words between the two words of a pair: neighbours, then skip-grams.
GAPS = (1, 2)
#: Lengths in bytes of the stems of longer words.
STEMS = (4, 6)
_BIAS = -1


def features(texts: pa.Array | pa.ChunkedArray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of a batch and the row of each; repeats within a row are still there."""
    found = textkit.words(texts, marks=True)
    row = np.repeat(np.arange(len(found.rows) - 1), np.diff(found.rows))
    slots, rows = [found.hashes >> np.uint64(64 - bits)], [row]
    for size in STEMS:
        longer = found.ends - found.starts > size
        stem = textkit.range_hashes(found.data, found.starts[longer], found.starts[longer] + size)
        slots.append(textkit.mix64(stem + np.uint64(size)) >> np.uint64(64 - bits))
        rows.append(row[longer])
    for gap in GAPS:
        first, second = found.hashes[:-gap], found.hashes[gap:]
        same = row[:-gap] == row[gap:]
        with np.errstate(over="ignore"):
            pair = textkit.mix64(first[same] * np.uint64(2 * gap + 1) + textkit.mix64(second[same]))
        slots.append(pair >> np.uint64(64 - bits))
        rows.append(row[:-gap][same])
    return np.concatenate(slots).astype(np.int64), np.concatenate(rows)


def distinct_features(texts: pa.Array | pa.ChunkedArray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each slot once per row: slots, and the first of each row."""
    slots, rows = features(texts, bits)
    keys = np.unique((rows << bits) | slots)
    return (keys & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(keys >> bits, np.arange(len(texts) + 1))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, first = distinct_features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("label"),
             pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(slots, pa.int32()))],
            ["place", "label", "slots"],
        )


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights per slot and the bias after `epochs` passes over the examples in their order.

    Every coordinate has its own rate ALPHA / (BETA + sqrt(sum of its squared gradients)), and a weight
    is zero until its accumulated gradient exceeds L1. The bias has no L1 term.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for slots, label in zip(examples, labels):
            zs, ns = z[slots], n[slots]
            root = np.sqrt(ns)
            weights = np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + root) / ALPHA + L2))
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(weights.sum() + bias, -35, 35)))
            g = p - label
            z[slots] = zs + g - (np.sqrt(ns + g * g) - root) / ALPHA * weights
            n[slots] = ns + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    weights = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return weights, -bias_z / ((BETA + bias_n**0.5) / ALPHA)


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by([("place", "ascending"), ("label", "ascending")])
    lists = table.column("slots").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    first, slots = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    examples = [slots[a:b] for a, b in zip(first[:-1], first[1:])]
    weights, bias = ftrl(examples, table.column("label").to_numpy().astype(float))
    kept = np.flatnonzero(weights)
    return pa.table({
        "slot": pa.array(np.concatenate(([_BIAS], kept)), pa.int32()),
        "weight": pa.array(np.concatenate(([bias], weights[kept])), pa.float64()),
    })


@dataclass
class ToxicityModel:
    """Broadcast weights (2**bits numbers) and the bias."""

    weights: Broadcast
    bias: float

    def scores(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        weights = self.weights.value
        slots, rows = features(texts)
        live = weights[slots] != 0
        keys = np.unique((rows[live] << BITS) | slots[live])
        found = weights[keys & ((1 << BITS) - 1)].astype(float)
        total = np.bincount(keys >> BITS, weights=found, minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def train(examples: DataFrame, key: str, text: str, label: str, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Model from the rows of `examples` with a label; about `rows` keys at most, chosen by a hash of the key.

    Rows with a null key or label are left out, a key counts once, a null text is empty. Without any
    example every score is one half.
    """
    spark = examples.sparkSession
    textkit.limit_batches(spark)
    usable = examples.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.xxhash64(key).alias("place"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")
    )
    return fit(_sampled(usable, rows).dropDuplicates(["place"]))


def _sampled(usable: DataFrame, rows: int) -> DataFrame:
    share = min(1.0, rows / max(1, usable.select("place").count()))
    return usable.where(F.pmod(F.col("place"), F.lit(1_000_000)) < int(share * 1_000_000))


def train_labelled(documents: DataFrame, labels: DataFrame, eligible: Column, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Model from the labels of eligible ids; the chosen labels (about `rows`) are broadcast to the scan of the texts.

    A repeated id has the larger of its labels and one of its texts.
    """
    textkit.limit_batches(documents.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & eligible).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    chosen = _sampled(known.withColumn("place", F.xxhash64("doc_id")), rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit(texts.select("place", "text", "label").dropDuplicates(["place"]))


def fit(examples: DataFrame) -> ToxicityModel:
    """Learn from a bounded table (place, text, label); examples are visited in the order of their hashes."""
    spark = examples.sparkSession
    found = (
        examples.mapInArrow(_featurise, "place long, label int, slots array<int>")
        .withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit, "slot int, weight double").collect()  # bounded by 2**BITS + 1 rows
    )
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    for slot, weight in found:
        if slot == _BIAS:
            bias = weight
        else:
            weights[slot] = weight
    return ToxicityModel(spark.sparkContext.broadcast(weights), bias)


def score(frame: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted of every row; other columns are not read. Null and empty texts get the bias alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [key, "score", "predicted"]
            )

    kind = frame.schema[key].dataType.simpleString()
    return frame.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def keep_clean(frame: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `frame`, all columns as they are, whose score is below the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(text)) < threshold))

    return frame.mapInArrow(run, frame.schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether the row is kept from training: crc32 of the id as text is a multiple of five (null counts as an empty id)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def load_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> ToxicityModel:
    """The model of a data folder, from the labels of its training fold."""
    return train_labelled(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
