"""Alignment of two tokenizers over the same bytes, and how many documents hold each pair of linked ids.

Both tokenizers have a boundary before every space that follows a character other than white space, so texts are cut into
stretches there, groups never cross a cut, and a distinct stretch of a block is aligned once.

Distinct pairs of ids get the slots of minimal perfect hashes, one for each part of the pairs' hash space. Counts are dense
vectors over a part's slots, made per slice of the blocks, with keys verified, and summed up a tree. A second pass aligns
the documents again, block by block, from the ids that the first one kept, with the counts of just the pairs that the block
has asked for. So no task holds more than one block, one part or one slice, however many documents and pairs there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threadtide.llm import chunked, textkit
from threadtide.llm.mph import Mph
from threadtide.llm.shared import keep

#: Text of a block, about; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Text per part of the pairs' hash space, and the most parts: with all pairs of two vocabularies a part has some millions.
PART_BYTES, MOST_PARTS = 64 << 20, 512
#: Blocks whose pairs one leaf of the tree counts, and vectors that a node adds up.
SLICE_BLOCKS, FAN_IN = 64, 8
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


@dataclass
class Aligned:
    """A block's texts: per distinct stretch its ids and groups, per row its stretches; and the links of distinct stretches.

    Links are distinct (stretch, pair) with the number of their occurrences.
    """

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    said: pa.Array
    good: np.ndarray
    codes: np.ndarray
    rows: np.ndarray
    link_stretch: np.ndarray
    link_pair: np.ndarray
    link_times: np.ndarray

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sum over the stretches of every row; a row with a stretch whose bytes differ has nothing."""
        sums = np.concatenate(([0], np.cumsum(values[self.codes])))
        return np.where(self.row_good(), sums[self.rows[1:]] - sums[self.rows[:-1]], 0)

    def row_good(self) -> np.ndarray:
        bad = np.concatenate(([0], np.cumsum(~self.good[self.codes])))
        return (bad[self.rows[1:]] == bad[self.rows[:-1]]) & (np.diff(self.rows) > 0)


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


@dataclass
class Encoded:
    """ids of both tokenizers over a block's distinct stretches, and how many each stretch has: none where its bytes differ."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray

    def to_bytes(self) -> bytes:
        """Each array with its length, in the narrowest whole numbers that hold it: all first bytes, all second ones, compressed."""
        out = []
        for values in (self.a, self.n_a, self.b, self.n_b):
            kind = np.min_scalar_type(int(values.max(initial=0)))
            out += [np.array([kind.itemsize, len(values)], np.int64).tobytes(), values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()]
        raw = b"".join(out)
        return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Encoded:
        size = int(np.frombuffer(raw, np.int64, 1)[0])
        raw = pa.decompress(raw[8:], size, "zstd", asbytes=True)
        found, at = [], 0
        for _ in range(4):
            width, n = np.frombuffer(raw, np.int64, 2, at)
            split = np.frombuffer(raw, np.uint8, width * n, at + 16).reshape(width, n)
            found.append(np.ascontiguousarray(split.T).view(f"u{width}").ravel().astype(np.int64))
            at += 16 + int(width * n)
        return cls(*found)


def cut(texts: pa.Array) -> chunked.Stretches:
    """The stretches of space + text of every row."""
    return chunked.stretches(pc.fill_null(texts, ""), lead=" ")


def encode(cut: chunked.Stretches, first: chunked.Coder, second: chunked.Coder) -> Encoded:
    offsets, data = textkit.string_buffers(cut.distinct)
    (a, a_first), (b, b_first) = first.many(cut.distinct), second.many(cut.distinct)
    good = _same_bytes(first, a, a_first, offsets, data) & _same_bytes(second, b, b_first, offsets, data)
    n_a, n_b = np.diff(a_first), np.diff(b_first)
    return Encoded(a[np.repeat(good, n_a)], np.where(good, n_a, 0), b[np.repeat(good, n_b)], np.where(good, n_b, 0))


def align(texts: pa.Array, cut: chunked.Stretches, ids: Encoded, first: np.ndarray, second: np.ndarray) -> Aligned:
    """Groups and links of space + text of every row, with the byte lengths of both tokenizers' ids; empty texts have no stretch."""
    empty = pc.equal(pc.binary_length(pc.fill_null(texts, "")), 0).to_numpy(zero_copy_only=False)
    offsets, _ = textkit.string_buffers(cut.distinct)
    n = len(cut.distinct)
    a, b, n_a, n_b = ids.a, ids.b, ids.n_a, ids.n_b
    good = n_a > 0
    lengths = np.where(good, np.diff(offsets), 0)
    a_ends, b_ends = np.cumsum(first[a]), np.cumsum(second[b])
    stretch_ends = np.cumsum(lengths)
    for ends, counts in ((a_ends, n_a), (b_ends, n_b)):
        if len(counts) != n or not np.array_equal(np.append(0, ends)[np.cumsum(counts)], stretch_ends):
            raise ValueError("the ids are not those of the block's stretches")
    marked = np.zeros(int(lengths.sum()) + 1, bool)
    marked[b_ends] = True
    borders = a_ends[marked[a_ends]]  # ends of groups in the bytes of all good stretches
    n_groups = np.diff(np.searchsorted(borders, stretch_ends, "right"), prepend=0)
    group_a, group_b = np.searchsorted(borders, a_ends), np.searchsorted(borders, b_ends)
    group_stretch = np.searchsorted(stretch_ends, borders)
    said = _said(a, group_a, b, group_b, n_groups, len(borders))
    link_group, pairs, times = _links(a, group_a, b, group_b, len(borders))
    order = np.lexsort((pairs, group_stretch[link_group])) if len(pairs) else np.zeros(0, np.int64)
    owner, pairs, times = group_stretch[link_group][order], pairs[order], times[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(pairs)), bool), (owner[1:] != owner[:-1]) | (pairs[1:] != pairs[:-1]))))
    times = np.add.reduceat(times, new) if len(new) else times
    rows = cut.rows
    if empty.any():  # the leading space alone is no text
        sizes = np.diff(rows)
        codes = cut.codes[~np.repeat(empty, sizes)]
        rows = np.concatenate(([0], np.cumsum(np.where(empty, 0, sizes))))
    else:
        codes = cut.codes
    return Aligned(n_a, n_b, n_groups, said, good if n else np.zeros(0, bool), codes, rows, owner[new], pairs[new], times)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among ascending ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _distinct(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in ascending ones."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def _same_bytes(coder: chunked.Coder, ids: np.ndarray, firsts: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which stretches' ids give exactly their bytes."""
    ends = np.concatenate(([0], np.cumsum(coder.lengths[ids])))
    sizes = np.diff(ends[firsts])
    same = sizes == np.diff(offsets)
    made = coder.bytes_of(ids[np.repeat(same, np.diff(firsts))])
    given = data[np.repeat(same, np.diff(offsets))]
    wrong = np.repeat(np.flatnonzero(same), np.diff(offsets)[same])[made != given]
    same[wrong] = False
    return same


def _said(a, group_a, b, group_b, n_groups: np.ndarray, groups: int) -> pa.Array:
    """Per stretch its groups as text: ids with commas, a bar between the tokenizers, semicolons between groups."""
    def listed(ids, owner):
        return _joined(np.searchsorted(owner, np.arange(groups + 1)), pa.array(ids).cast(pa.string()), ",")

    both = pc.binary_join_element_wise(listed(a, group_a), listed(b, group_b), "|")
    return _joined(np.concatenate(([0], np.cumsum(n_groups))), both, ";")


def _joined(edges: np.ndarray, values: pa.Array, mark: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values), mark)


def _links(a, group_a, b, group_b, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair and number of occurrences of every distinct pair of ids in every group: the product of how often both occur."""
    def distinct(ids, owner):
        keys, times = np.unique(pair_of(owner, ids), return_counts=True)
        at = keys >> 32
        return keys & 0xFFFFFFFF, times, at, np.bincount(at, minlength=groups)

    (a_ids, a_times, a_at, _), (b_ids, b_times, _, b_sizes) = distinct(a, group_a), distinct(b, group_b)
    if not groups:
        return (np.zeros(0, np.int64),) * 3
    b_first = np.concatenate(([0], np.cumsum(b_sizes)[:-1]))
    spread = b_sizes[a_at]
    left = np.repeat(np.arange(len(a_ids)), spread)
    right = np.arange(int(spread.sum())) + np.repeat(b_first[a_at] - np.concatenate(([0], np.cumsum(spread)[:-1])), spread)
    return a_at[left], pair_of(a_ids[left], b_ids[right]), a_times[left] * b_times[right]


def part_of(pairs: np.ndarray, parts: int) -> np.ndarray:
    return (textkit.mix64(pairs.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def row_pairs(block: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct pairs in ascending order, and how many of its rows hold each."""
    pairs, at = np.unique(block.link_pair, return_inverse=True)
    sizes = np.diff(block.rows)
    held = np.sort(pair_of(np.repeat(np.arange(len(sizes)), sizes), block.codes))
    held = held[_distinct(held)]  # (row, stretch)
    row, code = held >> 32, held & 0xFFFFFFFF
    ok = block.row_good()[row]
    row, code = row[ok], code[ok]
    first = np.searchsorted(block.link_stretch, np.arange(len(block.good) + 1))
    spread = np.diff(first)[code]
    link = np.arange(int(spread.sum())) + np.repeat(first[code] - np.concatenate(([0], np.cumsum(spread)[:-1])), spread)
    # a pair may stand in several stretches of a row
    keys = np.sort(np.repeat(row, spread) * max(1, len(pairs)) + at[link])
    counts = np.bincount(keys[_distinct(keys)] % max(1, len(pairs)), minlength=len(pairs))
    return pairs[counts > 0], counts[counts > 0]


def results(block: Aligned, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """The columns of every row, from the counts of the block's pairs and whether each is its first id's highest."""
    n = len(block.good)
    used = _among(block.link_pair, pairs)  # pairs only of rows that have no tokens were not asked for
    at = np.searchsorted(pairs, block.link_pair[used])
    times, owner = block.link_times[used], block.link_stretch[used]
    per = lambda values: np.bincount(owner, weights=values, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
    sums = np.zeros(n, np.int64)
    np.add.at(sums, owner, times * counts[at])
    good = block.row_good()
    said = _joined(block.rows, block.said.take(pa.array(block.codes)), ";").to_pylist()
    digests = [hashlib.sha256(s.encode()).hexdigest() if ok else "" for s, ok in zip(said, good)]
    return {
        "n_a": block.per_row(block.n_a), "n_b": block.per_row(block.n_b), "n_groups": block.per_row(block.n_groups),
        "n_links": block.per_row(per(times)), "n_best": block.per_row(per(times * best[at])), "count_sum": block.per_row(sums), "groups_sha256": digests,
    }


def alignment(frame: DataFrame, definition: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the frame: its groups and links, and what all rows together hold of its pairs.

    `definition` is the JSON of the first tokenizer, `model` the second one's file (both bounded by their vocabularies). A text
    that is null, empty, or whose bytes either tokenizer does not give back has no tokens: zeros and an empty digest. Null and
    repeated keys are kept; every row counts as a document.
    """
    spark = frame.sparkSession
    textkit.limit_batches(spark)
    shared = spark.sparkContext.broadcast((definition, model))
    sizes = spark.sparkContext.broadcast([c.lengths for c in (chunked.byte_bpe(definition, plain=True), chunked.piece_bpe(model))])
    docs = frame.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(MOST_PARTS, 1 + size // PART_BYTES)
    slices = 1 + size // BLOCK_BYTES // SLICE_BLOCKS

    def coders():
        return chunked.byte_bpe(shared.value[0], plain=True), chunked.piece_bpe(shared.value[1])

    def first_pass(texts: pa.Array, both: tuple) -> tuple[np.ndarray, np.ndarray, bytes]:
        found = cut(texts)
        ids = encode(found, *both)
        return *row_pairs(align(texts, found, ids, *sizes.value)), ids.to_bytes()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = coders(), TaskContext.get().partitionId() << 32
        for table in chunked.gathered(batches, "text", BLOCK_BYTES):
            pairs, counts, ids = first_pass(table.column("text").combine_chunks(), both)
            yield _requests(block, table, None, [], [])
            yield _kept(block, ids)
            part = part_of(pairs, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            mine = [order[a:b] for a, b in zip(edges, edges[1:])]
            yield _requests(block, None, np.array([p for p, m in enumerate(mine) if len(m)], np.int32), [pairs[m] for m in mine if len(m)], [counts[m] for m in mine if len(m)])
            block += 1

    asked = keep(docs.mapInArrow(ask, "block bigint, place int, doc_id bigint, text string, part int, pairs array<bigint>, counts array<bigint>, ids binary"))
    requests = asked.where("part is not null").select("block", "part", (F.pmod(F.xxhash64("block"), F.lit(slices))).cast("int").alias("slice"), "pairs", "counts")

    def build(table: pa.Table) -> pa.Table:
        pairs = table.column("pair").to_numpy()
        found = Mph.build(pairs.view(np.uint64))
        by_slot = np.empty_like(pairs)
        by_slot[found.slots(pairs.view(np.uint64))] = pairs
        return pa.table({"part": table.column("part")[:1], "hash": pa.array([found.to_bytes()], pa.binary()), "keys": pa.array([by_slot.tobytes()], pa.binary())})

    distinct = requests.select("part", F.explode("pairs").alias("pair")).distinct()
    index = keep(distinct.groupBy("part").applyInArrow(build, "part int, hash binary, keys binary"))
    spread = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(int(slices) - 1))))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _vectors([])
        pairs, counts = _flat(left, "pairs"), _flat(left, "counts")
        found, keys = Mph.from_bytes(right.column("hash")[0].as_py()), np.frombuffer(right.column("keys")[0].as_py(), np.int64)
        slots = found.slots(pairs.view(np.uint64))
        if not np.array_equal(keys[slots], pairs):
            raise ValueError("a pair is not among the keys of its part")
        dense = np.bincount(slots, weights=counts, minlength=len(keys)).astype(np.int64)
        return _vectors([(left.column("part")[0].as_py(), left.column("slice")[0].as_py(), dense.tobytes())])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v.as_py(), np.int64) for v in table.column("vector")], axis=0)
        return _vectors([(table.column("part")[0].as_py(), table.column("slice")[0].as_py(), total.tobytes())])

    vectors = requests.groupBy("part", "slice").cogroup(spread.groupBy("part", "slice")).applyInArrow(count, VECTOR)
    width = slices
    while width > 1:
        width = -(-width // FAN_IN)
        vectors = vectors.withColumn("slice", F.floor(F.col("slice") / FAN_IN).cast("int")).groupBy("part", "slice").applyInArrow(add, VECTOR)
    totals = keep(index.join(vectors.select("part", "vector"), "part"))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, vector in zip(batch.column("keys"), batch.column("vector")):
                a = np.frombuffer(keys.as_py(), np.int64) >> 32
                ids, at = np.unique(a, return_inverse=True)
                most = np.zeros(len(ids), np.int64)
                np.maximum.at(most, at, np.frombuffer(vector.as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most)], ["a", "most"])

    tops = totals.select("keys", "vector").mapInArrow(highest, "a bigint, most bigint").groupBy("a").agg(F.max("most").alias("most"))
    most = {r["a"]: r["most"] for r in tops.collect()}  # at most one row per id of the first vocabulary
    top = spark.sparkContext.broadcast(np.array([most.get(i, 0) for i in range(max(most, default=0) + 1)], np.int64))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _answers([], [], [], [])
        pairs = _flat(left, "pairs")
        found = Mph.from_bytes(right.column("hash")[0].as_py())
        counts = np.frombuffer(right.column("vector")[0].as_py(), np.int64)[found.slots(pairs.view(np.uint64))]
        sizes = pc.list_value_length(left.column("pairs")).to_numpy()
        edges = np.cumsum(sizes)[:-1]
        return _answers(left.column("block").to_pylist(), np.split(pairs, edges), np.split(counts, edges), np.split(counts == top.value[pairs >> 32], edges))

    held = totals.select("part", "hash", "vector").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(int(slices) - 1))))
    answers = requests.select("block", "part", "slice", "pairs").groupBy("part", "slice").cogroup(held.groupBy("part", "slice")).applyInArrow(answer, ANSWER)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        held = pc.is_valid(left.column("ids"))
        ids = Encoded.from_bytes(left.filter(held).column("ids")[0].as_py())  # a block has one such row
        left = left.filter(pc.invert(held)).sort_by("place")  # the order of the rows gives the stretches their numbers
        texts = left.column("text").combine_chunks()
        block = align(texts, cut(texts), ids, *sizes.value)
        pairs, counts, best = (_flat(right, c) for c in ("pairs", "counts", "best"))
        order = np.argsort(pairs)
        columns = results(block, pairs[order], counts[order], best[order].astype(np.int64))
        return pa.table({"doc_id": left.column("doc_id"), **{n: pa.array(v) for n, v in columns.items()}})

    texts = asked.where("part is null").select("block", "place", "doc_id", "text", "ids")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, RESULT)


REQUEST = ["block", "place", "doc_id", "text", "part", "pairs", "counts", "ids"]
VECTOR = "part int, slice int, vector binary"
ANSWER = "block bigint, pairs array<bigint>, counts array<bigint>, best array<boolean>"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    edges = np.concatenate(([0], np.cumsum([len(v) for v in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _requests(block: int, table: pa.Table | None, part, pairs, counts) -> pa.RecordBatch:
    """Rows of a block: its documents, or the pairs that it asks for by part."""
    n = table.num_rows if table is not None else len(part)
    none = lambda kind: pa.nulls(n, kind)
    listed = pa.list_(pa.int64())
    if table is not None:
        mine = [pa.array(np.arange(n), pa.int32()), table.column("doc_id").combine_chunks(), table.column("text").combine_chunks().cast(pa.string()), none(pa.int32()), none(listed), none(listed)]
    else:
        mine = [none(pa.int32()), none(pa.int64()), none(pa.string()), pa.array(part, pa.int32()), _lists(pairs, pa.int64()), _lists(counts, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int64)), *mine, none(pa.binary())], REQUEST)


def _kept(block: int, ids: bytes) -> pa.RecordBatch:
    """The row of a block with its ids."""
    listed = pa.list_(pa.int64())
    nulls = [pa.nulls(1, kind) for kind in (pa.int32(), pa.int64(), pa.string(), pa.int32(), listed, listed)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *nulls, pa.array([ids], pa.binary())], REQUEST)


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return pc.list_flatten(table.column(column)).combine_chunks().to_numpy(zero_copy_only=False)


def _vectors(rows: list[tuple]) -> pa.Table:
    part, slice_, vector = ([r[i] for r in rows] for i in range(3))
    return pa.table({"part": pa.array(part, pa.int32()), "slice": pa.array(slice_, pa.int32()), "vector": pa.array(vector, pa.binary())})


def _answers(blocks: list[int], pairs, counts, best) -> pa.Table:
    return pa.table({"block": pa.array(blocks, pa.int64()), "pairs": _lists(pairs, pa.int64()), "counts": _lists(counts, pa.int64()), "best": _lists(best, pa.bool_())})
