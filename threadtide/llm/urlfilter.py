"""URL filters by a Bloom filter cascade.

The first filter holds the listed keys; the second the keys of the corpus that pass the first without
being listed; the third the listed keys that pass the second; and so on until no key of the corpus is
mistaken. The levels together tell listed keys from all others of the corpus exactly, in a broadcast
whose size follows the list, not the corpus, and pages are judged without a join or shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from threadtide.llm import textkit
from threadtide.llm.shared import cut

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Host labels whose hosts are listed as blocked where no rule fits.
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Levels at most; each one halves the keys that are still mistaken.
MAX_LEVELS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Level:
    """Bits of one filter (its size follows the number of keys in it) and the number of hash functions."""

    words: np.ndarray
    bits: int
    functions: int

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for position in positions(h1, h2, self.bits, self.functions):
            out &= (self.words[position >> 6] >> (position & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def positions(h1: np.ndarray, h2: np.ndarray, bits: int, functions: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for k in range(functions):
            yield ((h1 + np.uint64(k) * h2) % np.uint64(bits)).astype(np.int64)


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership of keys that were in the universe of the cascade."""
    out = np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    for depth, level in enumerate(levels):
        through = level.passes(h1[open_], h2[open_])
        out[open_[~through]] = depth % 2 == 1  # the last filter that was passed holds listed keys at even depths
        open_ = open_[through]
    out[open_] = len(levels) % 2 == 1
    return out


def _uint(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def sized(keys: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for a number of keys and a rate of false positives."""
    bits = max(64, math.ceil(keys * -math.log(rate) / math.log(2) ** 2))
    return bits, max(1, min(16, round(bits / max(keys, 1) * math.log(2))))


def build_level(keys: DataFrame, count: int, rate: float) -> Level:
    """A filter of `count` keys (h1, h2): partitions set bits, a combinable aggregate joins them."""
    bits, functions = sized(count, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(positions(_uint(batch.column("h1")), _uint(batch.column("h2")), bits, functions))))
            word, first = np.unique(at >> 6, return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    words = np.zeros((bits + 63) // 64, np.uint64)
    found = keys.select("h1", "h2").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    for row in found.collect():  # as many rows as the filter has words
        words[row.word] = np.array([row.value], np.int64).view(np.uint64)[0]
    return Level(words, bits, functions)


def _through(keys: DataFrame, level: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.value.passes(_uint(batch.column("h1")), _uint(batch.column("h2")))))

    return keys.mapInArrow(run, keys.schema)


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for a universe of distinct keys (h1, h2, listed); an empty list has no level."""
    spark = universe.sparkSession
    inside = cut(universe.where("listed").select("h1", "h2"))
    outside = universe.where("not listed").select("h1", "h2")
    n_in, n_out = inside.count(), universe.count()
    levels: list[Level] = []
    holds, other, count = inside, outside, n_in
    rate = min(0.5, max(1e-9, n_in / max(1, n_out) * 0.5**0.5))
    while count:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys of the universe share both hashes")
        level = build_level(holds, count, rate)
        levels.append(level)
        mistaken = cut(_through(other, spark.sparkContext.broadcast(level)))
        holds, other, count, rate = mistaken, holds, mistaken.count(), 0.5
    return levels


def with_parts(frame: DataFrame, url: str = "url") -> DataFrame:
    """`frame` with host and path of its urls; both are empty for a null url or one without ://."""
    rest = F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")
    usable = F.coalesce(F.locate("://", F.col(url)) > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return frame.withColumns({"host": F.when(usable, host).otherwise(""), "path": F.when(usable, path).otherwise("")})


def candidates(lengths: list[int]) -> Column:
    """Keys of a url that a rule may have, the longest first, then its host as the list has it.

    A rule key is host and path; of two as long the one with the longer host comes first.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = F.flatten(F.transform(suffixes, lambda s: F.transform(
        F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: F.length("path") >= n),
        lambda n: F.struct((-(F.length(s) + n)).alias("size"), (-F.length(s)).alias("host"), F.concat(s, F.expr("path").substr(F.lit(1), n)).alias("key")),
    )))
    keys = F.transform(F.array_sort(rules), lambda r: r["key"])
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.concat(keys, F.array(host_key(F.col("host")))))


def host_key(host: Column) -> Column:
    """How a listed host is written among the keys; no rule key begins like it."""
    return F.concat(F.lit("://"), host)


def judge(
    frame: DataFrame, key: str = "page_id", url: str = "url",
    rules: tuple[tuple[str, str, str], ...] = RULES, blocked_labels: tuple[str, ...] = BLOCKED_LABELS,
) -> DataFrame:
    """key, host, path, rule, verdict of every row.

    The longest fitting rule decides. Where none fits, a host with a blocked label is listed and blocked and
    all others are allowed. Rules and listed hosts are members of one cascade over all keys of the corpus.
    Null urls and urls without :// have empty parts, no rule and are allowed. Only key and url are read.
    """
    spark = frame.sparkSession
    textkit.limit_batches(spark)
    verdicts = {host + path: verdict for host, path, verdict in rules}
    lengths = sorted({len(path) for _, path, _ in rules})
    parts = with_parts(frame.select(F.col(key).alias("id"), F.col(url).alias("url")), "url").select("id", "host", "path")
    keyed = parts.withColumn("keys", candidates(lengths))
    on_list = F.col("key").isin(*verdicts) | (
        F.col("key").startswith("://") & F.arrays_overlap(F.split(F.substring_index("key", "://", -1), r"\."), F.array(*(F.lit(b) for b in blocked_labels)))
    )
    hashes = {"h1": F.xxhash64("key"), "h2": F.xxhash64("key", F.lit(1)).bitwiseOR(F.lit(1))}
    universe = cut(keyed.select(F.explode("keys").alias("key")).distinct().select(
        *(h.alias(name) for name, h in hashes.items()), on_list.alias("listed")
    ))
    levels = spark.sparkContext.broadcast(cascade(universe))
    hashed = keyed.withColumns({
        "h1": F.transform("keys", lambda k: F.xxhash64(k)), "h2": F.transform("keys", lambda k: F.xxhash64(k, F.lit(1)).bitwiseOR(F.lit(1)))
    })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(_offsets(batch.column("keys")))
            member = listed(levels.value, _uint(batch.column("h1").flatten()), _uint(batch.column("h2").flatten()))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            hit = np.flatnonzero(member)
            owner, first = np.unique(row[hit], return_index=True)
            found: list[str | None] = [None] * batch.num_rows
            chosen = batch.column("keys").flatten().take(pa.array(hit[first]))
            for i, name in zip(owner.tolist(), chosen.to_pylist()):
                found[i] = name
            rule = [None if f is None or f.startswith("://") else f for f in found]
            verdict = [verdicts[r] if r else "block" if f else "allow" for r, f in zip(rule, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                [key, "host", "path", "rule", "verdict"],
            )

    kind = frame.schema[key].dataType.simpleString()
    return hashed.mapInArrow(run, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _offsets(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy()


def oracle() -> str:
    """The same verdicts in SQL, rule by rule."""
    fits = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)
    labels = ", ".join(f"'{b}'" for b in BLOCKED_LABELS)
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (SELECT page_id, host, path, CASE {fits} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE rule {verdicts} ELSE CASE WHEN list_has_any(string_split(host, '.'), [{labels}]) THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled"""
