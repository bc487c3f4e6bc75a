"""Jaccard join of documents on word n-grams: MinHash bands find candidates, full n-gram sets decide.

Documents with equal n-gram sets form a class that is compared once, through its least id. Classes meet
in band buckets. A bucket larger than BLOCK is dealt into blocks, and every pair of blocks is compared
somewhere, so no bucket is cut and no task holds more than two blocks. A pair that meets in several
buckets counts in the first band only. Pairs never become rows: tasks return link counts and, for each
bucket, links to one root per connected part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadtide.llm import textkit
from threadtide.llm.components import components
from threadtide.llm.shared import cut

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9998
#: Classes in one block of a large bucket.
BLOCK = 256
#: Distinct n-grams in one step of the block product.
COLUMNS = 4096


@dataclass(frozen=True)
class Bands:
    count: int
    rows: int


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 3) -> Bands:
    """The fewest bands of `rows` hashes with which a pair at the threshold shares a band with probability `recall`."""
    miss = 1 - threshold**rows
    return Bands(1 if miss <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(miss))), rows)


def _factors(n: int) -> np.ndarray:
    return textkit.mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def ngram_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text; a text of fewer words has one n-gram, one without words none."""
    grams, rows = textkit.shingles(textkit.words(texts), size)
    return [np.unique(grams[a:b]) for a, b in zip(rows[:-1], rows[1:])]


def set_marks(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that stand for each set, as two columns of int64."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, grams in enumerate(sets):
        out[i, 0] = grams.sum(dtype=np.uint64) + np.uint64(len(grams))
        out[i, 1] = textkit.mix64(grams ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
    return textkit.mix64(out).view(np.int64)


def band_hashes(sets: list[np.ndarray], bands: Bands) -> np.ndarray:
    """One hash per set and band; rows of empty sets are zero."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), bands.count), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out.view(np.int64)
    grams = np.concatenate([sets[i] for i in full])
    first = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    factors = _factors(bands.count * bands.rows)
    with np.errstate(over="ignore"):
        for band in range(bands.count):
            joint = np.full(len(full), band, np.uint64)
            for k in range(bands.rows):
                least = np.minimum.reduceat((grams * factors[band * bands.rows + k]) >> np.uint64(24), first)
                joint = textkit.mix64(joint + least)
            out[full, band] = joint
    return out.view(np.int64)


def signatures(frame: DataFrame, bands: Bands, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """id, the mark of the n-gram set, its size and its band hashes for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ngram_sets(batch.column("text"), size)
            marks, hashes = set_marks(sets), band_hashes(sets, bands)
            first = np.arange(len(sets) + 1, dtype=np.int32) * bands.count
            lists = pa.ListArray.from_arrays(pa.array(first), pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.ascontiguousarray(marks[:, 0])), pa.array(np.ascontiguousarray(marks[:, 1])),
                 pa.array(np.array([len(s) for s in sets], np.int32)), lists],
                ["id", "m1", "m2", "grams", "bands"],
            )

    textkit.limit_batches(frame.sparkSession)
    return frame.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, m1 long, m2 long, grams int, bands array<long>"
    )


def meetings(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """site (bucket, or pair of blocks of a large one), band and block of every class that shares a bucket."""
    rows = classes.where("grams > 0").select("rep", F.posexplode("bands").alias("band", "bucket"))
    sizes = rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.join(sizes, ["band", "bucket"]).withColumn("parts", parts).withColumn(
        "block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    )
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "rep", "band", "block",
        F.xxhash64("band", "bucket", F.least("block", "other"), F.greatest("block", "other")).alias("site"),
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
    )


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two blocks of sets, as products of incidence matrices of common n-grams."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), COLUMNS):
        part = common[at : at + COLUMNS]
        out += _incidence(left, part) @ _incidence(right, part).T
    return out


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, grams in enumerate(sets):
        a, b = np.searchsorted(grams, (columns[0], columns[-1]))
        part = grams[a : b + 1]
        at = np.searchsorted(columns, part)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == part]] = 1
    return out


def links(sets: list[np.ndarray], bands: np.ndarray, band: int, block: np.ndarray, lo: int, hi: int, threshold: float) -> np.ndarray:
    """Pairs (as two index columns) of a site that are alike and meet in no earlier band."""
    left = np.flatnonzero(block == lo)
    right = left if lo == hi else np.flatnonzero(block == hi)
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64)
    sizes = np.array([len(s) for s in sets])
    both = intersections([sets[i] for i in left], [sets[i] for i in right])
    joint = sizes[left][:, None] + sizes[right][None, :] - both
    alike = both >= threshold * joint - 1e-6
    for k in range(band):
        alike &= bands[left, k][:, None] != bands[right, k][None, :]
    if lo == hi:
        alike = np.triu(alike, 1)
    a, b = np.nonzero(alike)
    return np.stack([left[a], right[b]], axis=1)


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member that each of n members is connected to."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([top(i) for i in range(n)])


class _Site:
    """Members of the site that is being read."""

    def __init__(self, threshold: float):
        self.threshold, self.site, self.where = threshold, None, (0, 0, 0)
        self.clear()

    def clear(self) -> None:
        self.reps, self.copies, self.sets, self.bands, self.blocks, self.seen = [], [], [], [], [], set()

    def add(self, rep: int, copies: int, grams: np.ndarray, bands: np.ndarray, block: int) -> None:
        if rep not in self.seen:  # an id that stands on several rows counts once
            self.seen.add(rep)
            for to, value in zip((self.reps, self.copies, self.sets, self.bands, self.blocks), (rep, copies, grams, bands, block)):
                to.append(value)

    def flush(self) -> list[tuple[int, int, int]]:
        """rep, root and linked documents of every member with a link."""
        reps, sets, bands, blocks = self.reps, self.sets, self.bands, self.blocks
        weight = np.array(self.copies, np.int64)
        self.clear()
        if len(reps) < 2:
            return []
        pairs = links(sets, np.array(bands), self.where[0], np.array(blocks), *self.where[1:], self.threshold)
        if not len(pairs):
            return []
        root = roots(len(reps), pairs)
        n = np.bincount(pairs[:, 0], weight[pairs[:, 1]], len(reps)) + np.bincount(pairs[:, 1], weight[pairs[:, 0]], len(reps))
        return [(reps[i], reps[root[i]], int(n[i])) for i in np.flatnonzero(n)]


def verified(members: DataFrame, bands: Bands, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """rep, root, links of the members (site, band, lo, hi, block, rep, m1, m2, copies, text), sorted by site."""
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def pack(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Site(threshold)
        for batch in textkit.sliced(batches, 100):
            sets = ngram_sets(batch.column("text"), size)
            marks, hashes = set_marks(sets), band_hashes(sets, bands)
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("site", "band", "lo", "hi", "block", "rep", "m1", "m2", "copies")}
            out = []
            for i in range(batch.num_rows):
                if column["site"][i] != now.site:
                    out += now.flush()
                    now.site, now.where = column["site"][i], tuple(int(column[c][i]) for c in ("band", "lo", "hi"))
                if marks[i, 0] == column["m1"][i] and marks[i, 1] == column["m2"][i]:  # another text may have the same id
                    now.add(int(column["rep"][i]), int(column["copies"][i]), sets[i], hashes[i], int(column["block"][i]))
            if out:
                yield pack(out)
        out = now.flush()
        if out:
            yield pack(out)

    return members.mapInArrow(run, "rep long, root long, links long")


def jaccard_join(
    frame: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """One row per row of `frame`: key (as bigint), copy_of, class_id, n_links.

    copy_of is the least id with the same n-gram set, class_id the least id that the row is connected to by
    links, n_links the number of other rows whose n-gram sets have a Jaccard similarity of at least `threshold`.
    Texts without words (null, empty) are copies of each other; rows with a null key get null ids and no links.
    Other columns are not read.
    """
    bands = choose_bands(threshold, recall)
    signed = cut(signatures(frame, bands, key, text, size))
    classes = cut(signed.where("id is not null").groupBy("m1", "m2").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")
    ))
    met = meetings(classes).join(classes.select("rep", "copies", "m1", "m2"), "rep")
    texts = frame.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text"))
    members = met.join(texts, "rep").select("site", "band", "lo", "hi", "block", "rep", "m1", "m2", "copies", "text")
    found = cut(verified(members.repartition("site").sortWithinPartitions("site"), bands, size, threshold))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found, "rep", "root").select(F.col("node").alias("rep"), "component")
    known = classes.select("m1", "m2", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    return signed.select("id", "m1", "m2").join(known, ["m1", "m2"], "left").select(
        F.col("id").alias(key),
        F.when(F.col("id").isNotNull(), F.col("rep")).alias("copy_of"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("class_id"),
        F.when(F.col("id").isNotNull(), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def keep_one(frame: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `frame`, all columns as they are, that stay when each class keeps its least id (null ids all stay).

    Rows that repeat an id and its text are kept once; an id that stands on different texts goes if one of them goes.
    """
    found = jaccard_join(frame, key, text, **how)
    gone = found.where(F.col("class_id") != F.col(key)).select(key).distinct()
    doubled = found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count()
    kept = frame.join(gone, key, "left_anti")
    if doubled:
        kept = kept.where(F.col(key).isNotNull()).dropDuplicates([key, text]).unionByName(kept.where(F.col(key).isNull()))
    return kept.select(*frame.columns)
