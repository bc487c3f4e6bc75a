"""Word hashing over Arrow string columns: the part that the operators on word sequences share.

A batch is hashed as one byte buffer, so the cost is a few array passes and no step runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes that one Arrow batch may hold; texts can be long, and two workers share an executor's free memory.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix finaliser)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


#: A random value for each byte at each place in a word.
_TABLE = mix64(np.arange(_SLOTS * 256, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = np.ones(256, bool)
_MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass
class Words:
    """Words of a batch: hash and byte range of each, and the first word of each row (one more entry at the end)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    data: np.ndarray

    def row(self, i: int) -> np.ndarray:
        return self.hashes[self.rows[i] : self.rows[i + 1]]


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (rebased to zero) and bytes of a string array without nulls."""
    wide = pa.types.is_large_string(texts.type)
    raw = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
    offsets = raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def plain(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> pa.Array:
    """One array of texts, nulls as empty texts, lower-cased on request."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts, "")
    return pc.utf8_lower(texts) if lower else texts


def words(texts: pa.Array | pa.ChunkedArray, marks: bool = False, lower: bool = True) -> Words:
    """Words of each text: runs between white space or, with `marks`, runs of letters and digits."""
    offsets, data = string_buffers(plain(texts, lower))
    return byte_words(offsets, data, _MARKS if marks else _SPACE)


def byte_words(offsets: np.ndarray, data: np.ndarray, separators: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64), data)
    gap = separators[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return Words(range_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets), data)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint ascending byte ranges."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    values = data[place + np.repeat(starts, lengths)].astype(np.int64)
    with np.errstate(over="ignore"):
        hashed = _TABLE[((place & (_SLOTS - 1)) << 8) | values]
        if int(lengths.max()) > _SLOTS:
            far = place >= _SLOTS
            hashed[far] = mix64(hashed[far] + (place[far] // _SLOTS).astype(np.uint64))
        return mix64(np.add.reduceat(hashed, firsts) + lengths.astype(np.uint64))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words, and the first of each row; a row with fewer words has one run of all it has."""
    counts = np.diff(found.rows)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    rows = np.concatenate(([0], np.cumsum(runs)))
    total = int(rows[-1])
    if not total:
        return np.zeros(0, np.uint64), rows
    first = np.repeat(found.rows[:-1], runs) + np.arange(total) - np.repeat(rows[:-1], runs)
    held = np.repeat(np.minimum(counts, size), runs)
    out = np.zeros(total, np.uint64)
    top = len(found.hashes) - 1
    with np.errstate(over="ignore"):
        for k in range(size):
            step = found.hashes[np.minimum(first + k, top)]
            out = np.where(held > k, mix64(out + step), out)
    return out, rows


def limit_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session's Python steps small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
