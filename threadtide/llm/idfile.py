"""Token ids in binary shard files, with a minimal perfect hash index from document keys to places in them.

A dataset is a folder:

* `shards/`: raw ids of the documents in ascending key order (2 bytes each where the vocabulary allows, else 4, little
  endian), then the place of every document's first id (8 bytes each, one more at the end), then a trailer.
* `index/`: per part of the keys' hash space the bits of a minimal perfect hash and, by slot, a fingerprint of the key and
  where its documents lie. A look is a hash, a slot, one comparison and one read at an offset.
* `manifest` and `parts`: Parquet tables of the shard and index files. Every attempt of a task writes a file of a new name,
  and only the names of finished attempts come into these tables, so a lost executor leaves unused files at worst.

Keys are 64-bit integers. Their fingerprint is an invertible mix of all bits, so it settles membership exactly. Documents
with equal keys follow each other in the order of a hash of their texts; those without a key come first, and only a
reading in order meets them. Null texts are empty. An empty document is its end id alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threadtide.llm import chunked, store, textkit
from threadtide.llm.mph import Mph

END_ID = 2
#: Bytes of text of a shard, and keys of a part of the index, about.
SHARD_BYTES = 32 << 20
PART_KEYS = 65_536
#: Text that is encoded at a time; documents whose places and ids that are read at a time (a longer document is read alone).
TASK_BYTES = 6 << 20
READ_DOCS = 100_000
READ_IDS = 4 << 20

_TRAILER = struct.Struct("<QQIHH4s")  # ids, documents, crc32 of the ids, bytes of an id, version, mark
_MARK, _VERSION = b"TIDS", 1
ENTRY = "key bigint, shard int, first bigint, docs bigint, file string, ids bigint"


class ShardWriter:
    """One shard, written front to back."""

    def __init__(self, path: str, width: int):
        system, self.path = store.opened(path)
        system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width, self.crc, self.places = system.open_output_stream(self.path), width, 0, [np.zeros(1, np.int64)]
        self.ids = self.docs = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.out.write(raw)
        self.crc = zlib.crc32(raw, self.crc)
        self.places.append(self.ids + np.cumsum(sizes))
        self.ids, self.docs = self.ids + len(ids), self.docs + len(sizes)

    def close(self) -> None:
        self.out.write(np.concatenate(self.places).astype("<u8").tobytes())
        self.out.write(_TRAILER.pack(self.ids, self.docs, self.crc, self.width, _VERSION, _MARK))
        self.out.close()


class ShardReader:
    """Documents of a shard by number: two reads each, whatever the size of the shard."""

    def __init__(self, path: str):
        system, inner = store.opened(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        self.ids, self.docs, self.crc, self.width, version, mark = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if (mark, version) != (_MARK, _VERSION):
            raise ValueError(f"{path} is no shard of token ids")
        self.table = self.ids * self.width

    def places(self, first: int, docs: int) -> np.ndarray:
        """Place of the first id of `docs` documents in a row, and of the end of the last."""
        return np.frombuffer(self.file.read_at(8 * (int(docs) + 1), self.table + 8 * int(first)), "<u8").astype(np.int64)

    def read(self, begin: int, end: int) -> np.ndarray:
        """The ids from one place to another."""
        return np.frombuffer(self.file.read_at(int(end - begin) * self.width, int(begin) * self.width), f"<u{self.width}").astype("<u4")

    def documents(self, first: int, docs: int) -> list[np.ndarray]:
        """The ids of `docs` documents in a row."""
        places = self.places(first, docs)
        return np.split(self.read(places[0], places[-1]), places[1:-1] - places[0])

    def check(self) -> bool:
        """Whether the ids are the ones that were written."""
        return zlib.crc32(self.file.read_at(self.table, 0)) == self.crc


@dataclass
class IndexPart:
    """One part of the index: the hash, and by slot the fingerprint and the range of rows of `runs` (shard, first, docs)."""

    hash: Mph
    marks: np.ndarray
    begins: np.ndarray
    runs: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, runs: np.ndarray) -> IndexPart:
        marks = textkit.mix64(keys.view(np.uint64))
        distinct, counts = np.unique(marks, return_counts=True)
        found = Mph.build(distinct)
        slots = found.slots(distinct)
        by_slot, sizes = np.empty_like(distinct), np.empty(len(distinct), np.int64)
        by_slot[slots], sizes[slots] = distinct, counts
        order = np.lexsort((runs[:, 1], runs[:, 0], found.slots(marks)))
        return cls(found, by_slot, np.concatenate(([0], np.cumsum(sizes))), runs[order])

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of runs of every key; an empty one for keys that are not there."""
        if not len(self.marks):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        marks = textkit.mix64(keys.view(np.uint64))
        slots = self.hash.slots(marks)
        there = (slots >= 0) & (self.marks[slots] == marks)
        slots = np.where(there, slots, 0)
        return np.where(there, self.begins[slots], 0), np.where(there, self.begins[slots + 1], 0)

    def to_bytes(self) -> bytes:
        raw = self.hash.to_bytes()
        sizes = np.array([len(raw), len(self.marks), len(self.runs)], "<u8")
        return b"".join([sizes.tobytes(), raw, self.marks.astype("<u8").tobytes(), self.begins.astype("<u8").tobytes(), self.runs.astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> IndexPart:
        size, keys, runs = (int(v) for v in np.frombuffer(raw, "<u8", 3))
        at = 24 + size
        marks = np.frombuffer(raw, "<u8", keys, at)
        begins = np.frombuffer(raw, "<u8", keys + 1, at + 8 * keys).astype(np.int64)
        rows = np.frombuffer(raw, "<u8", 3 * runs, at + 8 * (2 * keys + 1)).astype(np.int64).reshape(-1, 3)
        return cls(Mph.from_bytes(raw[24:at]), marks, begins, rows)

    @classmethod
    def open(cls, path: str) -> IndexPart:
        system, inner = store.opened(path)
        with system.open_input_file(inner) as file:
            return cls.from_bytes(file.read())


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the index that has a key."""
    return (textkit.mix64(keys.view(np.uint64) ^ np.uint64(0x5DEECE66D)) % np.uint64(parts)).astype(np.int32)


def _shard_tasks(path: str, coder_of, width: int, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = coder_of(), TaskContext.get().partitionId()
        file = f"{path}/shards/{shard:06d}-{uuid.uuid4().hex}.ids"
        out, last, since, nulls = None, None, 0, 0
        for table in chunked.gathered(batches, text, TASK_BYTES):
            out = out or ShardWriter(file, width)
            cut = chunked.stretches(textkit.plain(table.column(text), lower=False))
            ids, firsts = coder.many(cut.distinct)
            sizes = np.diff(firsts)[cut.codes]
            before = np.concatenate(([0], np.cumsum(sizes)))
            flat = ids[np.arange(before[-1]) + np.repeat(firsts[cut.codes] - before[:-1], sizes)]
            ends = before[cut.rows[1:]]
            keys = table.column(key).combine_chunks()
            known = keys.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            nulls += keys.null_count  # they come first
            begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(known)), bool), known[1:] != known[:-1])))
            names, places = known[begins], out.docs + keys.null_count + begins
            if last is not None and len(names) and names[0] == last:  # the last key goes on
                names, places = names[1:], places[1:]
            if len(names):
                if last is not None:
                    names, places = np.insert(names, 0, last), np.insert(places, 0, since)
                if len(names) > 1:
                    yield _entries(names[:-1], places[:-1], np.diff(places), shard)
                last, since = names[-1], places[-1]
            out.add(np.insert(flat, ends, END_ID), np.diff(ends, prepend=0) + 1)
        if out:
            out.close()
            if last is not None:
                yield _entries([last], [since], [out.docs - since], shard)
            yield _entries([None], [nulls], [out.docs], shard, file, out.ids)

    return run


def _entries(key, first, docs, shard: int, file: str | None = None, ids: int | None = None) -> pa.RecordBatch:
    """Rows of keys and their places or, with a file, the row of the shard itself: its documents without a key and all of them."""
    n = len(first)
    numbers = [pa.array(column, pa.int64()) for column in (key, first, docs)]
    rest = [pa.array([shard] * n, pa.int32()), pa.array([file] * n, pa.string()), pa.array([ids] * n, pa.int64())]
    return pa.RecordBatch.from_arrays([numbers[0], rest[0], numbers[1], numbers[2], *rest[1:]], ["key", "shard", "first", "docs", "file", "ids"])


def write(
    frame: DataFrame, path: str, definition: str, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS
) -> None:
    """Encode every text, append the end id, and write shards and index to the new folder `path`.

    `definition` is the JSON of a byte-level tokenizer (bounded by its vocabulary; it goes to the tasks). Strings of its
    special tokens become those tokens, as the tokenizer's own defaults have it. An empty table makes an empty dataset.
    """
    spark = frame.sparkSession
    textkit.limit_batches(spark)
    shared = spark.sparkContext.broadcast(definition)
    width = 2 if len(chunked.byte_bpe(definition, plain=False).raw) <= 1 << 16 else 4
    columns = frame.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    size = columns.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    shards = (
        columns.withColumn("row", F.monotonically_increasing_id())  # repeated rows may share no task
        .repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order).drop("row")
    )
    task = _shard_tasks(path, lambda: chunked.byte_bpe(shared.value, plain=False), width, "key", "text")
    shards.mapInArrow(task, ENTRY).write.parquet(f"{path}/entries")
    entries = spark.read.schema(ENTRY).parquet(f"{path}/entries")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row per shard
    (
        entries.where(F.col("file").isNotNull())
        .select("shard", "file", F.col("first").alias("nulls"), "docs", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
        .write.parquet(f"{path}/manifest")
    )
    keyed = entries.where(F.col("file").isNull())
    parts = max(1, -(-keyed.count() // part_keys))
    spark.createDataFrame([(parts,)], "parts int").write.parquet(f"{path}/layout")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = part_of(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64), parts)
            yield batch.append_column("part", pa.array(part, pa.int32()))

    def build(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        file = f"{path}/index/{part:06d}-{uuid.uuid4().hex}.mph"
        runs = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("shard", "first", "docs")], axis=1)
        raw = IndexPart.build(table.column("key").to_numpy().astype(np.int64), runs).to_bytes()
        system, inner = store.opened(file)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(raw)
        return pa.table({"part": pa.array([part], pa.int32()), "index": pa.array([file])})

    numbered = keyed.select("key", "shard", "first", "docs").mapInArrow(number, "key bigint, shard int, first bigint, docs bigint, part int")
    numbered.groupBy("part").applyInArrow(build, "part int, index string").write.parquet(f"{path}/parts")


def look(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, shard, first, docs: where the documents of every distinct key lie; no row for keys that the dataset does not have."""
    spark = keys.sparkSession
    parts = spark.read.parquet(f"{path}/layout").first()[0]
    files = spark.read.schema("part int, index string").parquet(f"{path}/parts")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(part_of(batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64), parts), pa.int32()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index = None, None
        for batch in batches:
            asked, names = batch.column("key").to_numpy(zero_copy_only=False), batch.column("index").to_pylist()
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if names[low] != name:
                    name, index = names[low], IndexPart.open(names[low])
                begin, end = index.look(asked[low:high].astype(np.int64))
                counts = end - begin
                rows = index.runs[np.arange(int(counts.sum())) + np.repeat(begin - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked[low:high], counts), pa.int64()), *(pa.array(rows[:, i]).cast(t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64())))],
                    ["key", "shard", "first", "docs"],
                )

    asked = keys.select(F.col(key).cast("bigint").alias("key")).where("key is not null").distinct()
    placed = asked.mapInArrow(number, "key bigint, part int").join(files, "part")
    return placed.repartition("part").sortWithinPartitions("part").select("key", "index").mapInArrow(find, "key bigint, shard int, first bigint, docs bigint")


MANIFEST = "shard int, file string, nulls bigint, docs bigint, ids bigint, start bigint"


def read(places: DataFrame, path: str) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of the documents at the given places (key, shard, first, docs), read from the shards.

    start counts the ids of all documents before, in the whole dataset.
    """
    manifest = places.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            files = batch.column("file").to_pylist()
            keys, starts, firsts, docs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "first", "docs"))
            ends = firsts + docs
            edges = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1] or firsts[i] != ends[i - 1]), len(files)]
            for low, high in zip(edges, edges[1:]):  # places that follow each other are one read
                if low == high:
                    continue
                if files[low] != name:
                    name, shard = files[low], ShardReader(files[low])
                owner = pa.array(keys[low:high], pa.int64(), from_pandas=True).take(pa.array(np.repeat(np.arange(high - low), docs[low:high])))
                for at in range(0, len(owner), READ_DOCS):
                    bounds = shard.places(firsts[low] + at, min(READ_DOCS, len(owner) - at))
                    done = 0
                    while done < len(bounds) - 1:
                        upto = max(done + 1, int(np.searchsorted(bounds, bounds[done] + READ_IDS, "right")) - 1)
                        raw, local = shard.read(bounds[done], bounds[upto]).tobytes(), 4 * (bounds[done : upto + 1] - bounds[done])
                        crcs = [zlib.crc32(raw[a:b]) for a, b in zip(local, local[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [owner.slice(at + done, upto - done), pa.array(starts[low] + bounds[done:upto]), pa.array(np.diff(bounds[done : upto + 1])), pa.array(crcs, pa.int64())],
                            ["key", "start", "n_tokens", "ids_crc32"],
                        )
                        done = upto

    located = places.join(manifest.select("shard", "file", "start"), "shard").repartition("shard").sortWithinPartitions("shard", "first")
    return located.select("key", "file", "start", "first", "docs").mapInArrow(fetch, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def unkeyed(spark: SparkSession, path: str) -> DataFrame:
    """Places of the documents without a key."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return manifest.where("nulls > 0").select(F.lit(None).cast("bigint").alias("key"), "shard", F.lit(0).cast("bigint").alias("first"), F.col("nulls").alias("docs"))


class Dataset:
    """Keyed access to a dataset from one process: the names of its files are held, everything else is read at its place."""

    def __init__(self, spark: SparkSession, path: str):
        self.parts = spark.read.parquet(f"{path}/layout").first()[0]
        self.files = {r["part"]: r["index"] for r in spark.read.schema("part int, index string").parquet(f"{path}/parts").collect()}
        self.shards = {r["shard"]: r["file"] for r in spark.read.schema("shard int, file string").parquet(f"{path}/manifest").collect()}

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        asked = np.array([key], np.int64)
        part = int(part_of(asked, self.parts)[0])
        if part not in self.files:
            return []
        index = IndexPart.open(self.files[part])
        begin, end = index.look(asked)
        found = index.runs[begin[0] : end[0]]
        return [ids for shard, first, docs in found for ids in ShardReader(self.shards[int(shard)]).documents(first, docs)]
