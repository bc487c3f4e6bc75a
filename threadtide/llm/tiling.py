"""Benchmark decontamination by greedy string tiling.

Seeds (runs of LEAST words) of the benchmark are looked up in every document. A document and an item
that share enough seeds are tiled: the longest common run of words that no tile covers yet becomes a
tile, again and again, with running Karp-Rabin hashes to find it. The share of the item's words under
tiles counts, wherever the tiles lie, so reordered passages are caught.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from threadtide.llm import textkit

#: Words of the shortest tile; an item with fewer words is one tile.
LEAST = 5
THRESHOLD = 0.5
#: Benchmark words in one broadcast block; a larger benchmark takes one scan of the documents per block.
BLOCK_WORDS = 1_000_000
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Seeds:
    """Items of a block with the words of each, and their seeds of one size in hash order."""

    ids: list
    words: list[np.ndarray]
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def seeds(ids: list, texts: pa.Array, least: int = LEAST) -> Seeds:
    found = textkit.words(texts, marks=True)
    words = [found.row(i) for i in range(len(ids))]
    tables = {}
    for size in sorted({min(least, len(w)) for w in words if len(w)}):
        rows: list[tuple[np.ndarray, int]] = []
        for i, w in enumerate(words):
            if min(least, len(w)) == size:
                rows.append((runs(w, size), i))
        hashes = np.concatenate([h for h, _ in rows])
        item = np.concatenate([np.full(len(h), i) for h, i in rows])
        place = np.concatenate([np.arange(len(h)) for h, _ in rows])
        order = np.argsort(hashes, kind="stable")
        distinct, first = np.unique(hashes[order], return_index=True)
        lookup = np.zeros(1 << _BITS, bool)
        lookup[distinct >> np.uint64(64 - _BITS)] = True
        tables[size] = (lookup, distinct, np.append(first, len(order)), item[order], place[order])
    return Seeds(ids, words, tables)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words of one sequence."""
    one = textkit.Words(words, words, words, np.array([0, len(words)]), words)
    return textkit.shingles(one, size)[0] if len(words) >= size else np.zeros(0, np.uint64)


class _Rolling:
    """Hashes of all windows of any length of a word sequence."""

    def __init__(self, values: np.ndarray, total: int):
        n = len(values)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(total, _BASE, np.uint64))))
            self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values * power[:n], dtype=np.uint64)))
            self.align = power[total - np.arange(n + 1)]

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[starts + size] - self.sums[starts]) * self.align[starts]


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows without a marked word."""
    if len(marked) < size:
        return np.zeros(0, np.int64)
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[size:] == sums[:-size])


def tiles(item: np.ndarray, text: np.ndarray, least: int, marked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start in the item, start in the text, words) of the greedy tiles; words marked in the text are left alone.

    Among equally long matches the first in the item, then the first in the text, is taken.
    """
    total = max(len(item), len(text))
    p, t = _Rolling(item, total), _Rolling(text, total)
    p_mark, t_mark = np.zeros(len(item), bool), np.zeros(len(text), bool) if marked is None else marked.copy()

    def matches(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = _free(p_mark, size), _free(t_mark, size)
        x, y = p.windows(a, size), t.windows(b, size)
        in_a, in_b = np.isin(x, y), np.isin(y, x)
        return a[in_a], x[in_a], b[in_b], y[in_b]

    out = []
    top = min(len(item), len(text))
    while True:
        low, high = least - 1, top
        while low < high:  # a match of some length holds matches of all shorter ones
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(matches(middle)[0]) else (low, middle - 1)
        if low < least:
            return out
        top = low
        a, x, b, y = matches(top)
        for start, value in zip(a.tolist(), x):
            if p_mark[start : start + top].any():
                continue
            for at in b[y == value].tolist():
                if not t_mark[at : at + top].any() and np.array_equal(item[start : start + top], text[at : at + top]):
                    p_mark[start : start + top] = t_mark[at : at + top] = True
                    out.append((start, at, top))
                    break
        if not len(out) or out[-1][2] != top:  # equal hashes of unequal words only
            top -= 1


def matches(text: np.ndarray, block: Seeds, threshold: float = THRESHOLD) -> list[tuple[int, float, list[tuple[int, int, int]]]]:
    """(item index, covered share, tiles) of every item of which the words of one text cover enough."""
    out = []
    for size, table in block.tables.items():
        out += _matches(text, runs(text, size), block, size, table, threshold)
    return out


def _matches(text, grams, block: Seeds, size: int, table, threshold: float):
    lookup, distinct, first, items, places = table
    at = np.flatnonzero(lookup[grams >> np.uint64(64 - _BITS)])
    if not len(at):
        return []
    slot = np.minimum(np.searchsorted(distinct, grams[at]), len(distinct) - 1)
    hit = distinct[slot] == grams[at]
    at, slot = at[hit], slot[hit]
    if not len(at):
        return []
    shared = np.unique(slot)
    rows = np.concatenate([np.arange(first[s], first[s + 1]) for s in shared])
    out = []
    for item in np.unique(items[rows]):
        words = block.words[item]
        mine = rows[items[rows] == item]
        bound = np.zeros(len(words) + 1, np.int64)  # tiles lie under seeds, so seeds bound what tiles can cover
        np.add.at(bound, places[mine], 1)
        np.add.at(bound, places[mine] + size, -1)
        if (np.cumsum(bound[:-1]) > 0).sum() < threshold * len(words):
            continue
        own = np.unique(np.searchsorted(first, mine, side="right") - 1)
        spots = at[np.isin(slot, own)]
        near = np.unique((spots[:, None] + np.arange(size)[None, :]).ravel())
        breaks = np.flatnonzero(np.diff(near) > 1) + 1
        part = np.insert(text[near], breaks, 0)
        place = np.insert(near, breaks, -1)
        found = tiles(words, part, size, place < 0)
        covered = sum(n for _, _, n in found) / len(words)
        if covered >= threshold:
            out.append((int(item), covered, sorted((int(place[b]), n, a) for a, b, n in found)))
    return out


def item_blocks(benchmark: DataFrame, least: int = LEAST) -> list[Broadcast]:
    """The benchmark as broadcast blocks of about BLOCK_WORDS words each; null texts and texts without words match nothing."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_WORDS))
    dealt = benchmark.select("item_id", "text").where("text is not null").withColumn(
        "block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    )
    out = []
    for k in range(blocks):
        rows = dealt.where(F.col("block") == k).orderBy("item_id").collect()  # about BLOCK_WORDS words
        if rows:
            out.append(spark.sparkContext.broadcast(seeds([r.item_id for r in rows], pa.array([r.text for r in rows]), least)))
    return out


def find(frame: DataFrame, blocks: list[Broadcast], key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item it covers enough: key, item_id, coverage, n_tiles, tiled_words, spans.

    spans are (start, words, item_start) in words of letters and digits. Other columns of `frame` are not read.
    """
    kind = frame.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("item_start", pa.int32())]))

    def scan(block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = block.value
            for batch in batches:
                found = textkit.words(batch.column(1), marks=True)
                rows = [(i, *m) for i in range(batch.num_rows) for m in matches(found.row(i), held, threshold)]
                if rows:
                    spans = [[{"start": a, "words": n, "item_start": p} for a, n, p in r[3]] for r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([r[0] for r in rows])), pa.array([held.ids[r[1]] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows]), pa.array([len(r[3]) for r in rows], pa.int32()),
                         pa.array([sum(n for _, n, _ in r[3]) for r in rows], pa.int32()), pa.array(spans, span)],
                        [key, "item_id", "coverage", "n_tiles", "tiled_words", "spans"],
                    )

        return frame.select(key, text).mapInArrow(
            run, f"`{key}` {kind}, item_id long, coverage double, n_tiles int, tiled_words int, "
            "spans array<struct<start int, words int, item_start int>>"
        )

    textkit.limit_batches(frame.sparkSession)
    out = scan(blocks[0]) if blocks else scan(frame.sparkSession.sparkContext.broadcast(seeds([], pa.array([], pa.string()))))
    for block in blocks[1:]:
        out = out.unionByName(scan(block))
    return out


def keep_clean(frame: DataFrame, blocks: list[Broadcast], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `frame`, all columns as they are, that cover no item enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = textkit.words(batch.column(text), marks=True)
            clean = [not any(matches(found.row(i), b.value, threshold) for b in blocks) for i in range(batch.num_rows)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    textkit.limit_batches(frame.sparkSession)
    return frame.mapInArrow(run, frame.schema)
