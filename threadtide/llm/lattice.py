"""Language-model scores from a subword lattice.

A word's probability is the sum over all its segmentations into pieces of an existing vocabulary. The
vocabulary's scores weight the segmentations at first; a few rounds of expectation maximisation over the
words of the training documents then set the piece probabilities. No piece crosses a word, so a text's
marginal probability is the product over its words and its end, and each distinct word of the corpus goes
through the forward recursion once, in a table that is spread over the cluster. A training word is one more
arc of its lattice, from start to end, with its discounted frequency; the pieces share the discounted rest,
so the sum stays a probability. Texts meet their words' probabilities block by block: a block asks the table
for its distinct words, not for each occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadtide.llm import textkit
from threadtide.llm.pieces import LITERAL, MODEL_FILE, SPACE, Pieces, load
from threadtide.llm.shared import cut, partitions

ROUNDS = 3
#: Expected count that every piece has before any text is seen.
PRIOR = 0.02
#: Bytes of text in a block, and words that are reduced to distinct ones at a time.
BLOCK_BYTES = 32 << 20
FLUSH_WORDS = 1_000_000
#: Words whose lattices are computed together; longer words go through one at a time.
CHUNK, LONG = 2048, 48
_LOG10 = math.log(10)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 21


class Lattice:
    """Pieces by hash, for many words at a time."""

    def __init__(self, pieces: Pieces):
        usable = [p for p in pieces.ids if SPACE not in p.lstrip(SPACE)]
        self.longest = max(map(len, usable))
        self.n_pieces = len(pieces.names)
        hashes = np.array([self._hash(p) for p in usable], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([pieces.ids[p] for p in usable], np.int32)[order]
        self.lookup = np.zeros(1 << _FILTER_BITS, bool)
        self.lookup[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True
        self.single = {p: pieces.ids[p] for p in usable if len(p) == 1}
        self.byte_ids = np.array([pieces.byte_ids[b] for b in range(256)])

    @staticmethod
    def _hash(piece: str) -> int:
        value = 0
        for c in piece:
            value = ((value + ord(c) + 1) * int(_BASE)) & (2**64 - 1)
        return value

    def first_weights(self, pieces: Pieces) -> np.ndarray:
        """Log probabilities from the vocabulary's scores: these are negative ranks, so Zipf's law over the ranks."""
        weight = np.zeros(self.n_pieces)
        for i in self.ids:
            weight[i] = 1 / (2.7 + max(0.0, -pieces.scores[i])) if pieces.scores[i] > -1e8 else 0
        weight[self.byte_ids] = 1 / (2.7 + self.n_pieces)
        weight += PRIOR / self.n_pieces
        return np.log(weight / weight.sum())

    def spell(self, word: str) -> str:
        return SPACE + word.replace(SPACE, LITERAL)

    def _found(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For words of equal length: piece ids of all parts by length (-1: none), and which characters are no piece."""
        n, size = codes.shape
        out, running = [], np.zeros((n, size), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(self.longest, size)):
                width = size - k
                running = (running[:, :width] + codes[:, k:].astype(np.uint64) + np.uint64(1)) * _BASE
                ids = np.full((n, width), -1, np.int32)
                rows, at = np.nonzero(self.lookup[running >> np.uint64(64 - _FILTER_BITS)])
                value = running[rows, at]
                slot = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
                hit = self.hashes[slot] == value
                ids[rows[hit], at[hit]] = self.ids[slot[hit]]
                out.append(ids)
        return out, out[0] < 0

    def _weights(self, found: list[np.ndarray], lone: np.ndarray, codes: np.ndarray, logp: np.ndarray) -> list[np.ndarray]:
        """Log weights of all parts; a character that is no piece is spelt in bytes."""
        padded = np.append(logp, -np.inf)
        out = [padded[ids] for ids in found]
        if lone.any():
            values = {int(c): sum(float(logp[self.byte_ids[b]]) for b in self._bytes(int(c))) for c in np.unique(codes[lone])}
            out[0][lone] = [values[int(c)] for c in codes[lone]]
        return out

    @staticmethod
    def _bytes(code: int) -> bytes:
        return (SPACE if chr(code) == LITERAL else chr(code)).encode()

    def forward(self, weights: list[np.ndarray], size: int) -> np.ndarray:
        n = len(weights[0])
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, size + 1):
            terms = np.stack([alpha[:, end - k - 1] + weights[k][:, end - k - 1] for k in range(min(len(weights), end))], 1)
            alpha[:, end] = _logsum(terms)
        return alpha

    def backward(self, weights: list[np.ndarray], size: int) -> np.ndarray:
        n = len(weights[0])
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = 0
        for start in range(size - 1, -1, -1):
            terms = np.stack([beta[:, start + k + 1] + weights[k][:, start] for k in range(min(len(weights), size - start))], 1)
            beta[:, start] = _logsum(terms)
        return beta

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes and code points of words of equal length."""
        spelt = [self.spell(w) for w in words]
        sizes = np.array([len(s) for s in spelt])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = CHUNK if size <= LONG else max(1, CHUNK * LONG // int(size) // 4)
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                raw = "".join(spelt[i] for i in part).encode("utf-32-le", "surrogatepass")
                yield part, np.frombuffer(raw, np.uint32).reshape(len(part), size)

    def scores(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log probability of each word: the forward value at its end."""
        out = np.zeros(len(words))
        for part, codes in self.groups(words):
            found, lone = self._found(codes)
            weights = self._weights(found, lone, codes, logp)
            out[part] = self.forward(weights, codes.shape[1])[:, -1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected number of times that each piece is used in so many of each word."""
        out = np.zeros(self.n_pieces)
        for part, codes in self.groups(words):
            size = codes.shape[1]
            found, lone = self._found(codes)
            weights = self._weights(found, lone, codes, logp)
            alpha, beta = self.forward(weights, size), self.backward(weights, size)
            total = alpha[:, -1:]
            used, shares = [], []
            for k, ids in enumerate(found):
                at = np.nonzero(ids >= 0)
                share = np.exp(alpha[:, : size - k][at] + weights[k][at] + beta[:, k + 1 :][at] - total[at[0], 0]) * counts[part][at[0]]
                used.append(ids[at])
                shares.append(share)
                if k == 0 and lone.any():
                    share = np.exp(alpha[:, :size] + weights[0] + beta[:, 1:] - total) * counts[part][:, None]
                    for code, value in zip(codes[lone].tolist(), share[lone].tolist()):
                        for b in self._bytes(code):
                            out[self.byte_ids[b]] += value
            out += np.bincount(np.concatenate(used), weights=np.concatenate(shares), minlength=len(out))
        return out


def _logsum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(1)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(terms - safe[:, None]).sum(1)) + safe


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches joined to larger ones: words of one length are few in a small batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def held_out(key: str = "doc_id") -> Column:
    """Whether the row is kept from learning: crc32 of the id as text leaves two when divided by seven (null is an empty id)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def found_words(texts: pa.Array) -> textkit.Words:
    """Words of a batch with A-Z lower-cased and nothing else changed."""
    offsets, data = textkit.string_buffers(textkit.plain(texts, lower=False))
    return textkit.byte_words(offsets, np.where((data >= 65) & (data <= 90), data + np.uint8(32), data), textkit._SPACE)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], sizes) + np.repeat(starts, sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def word_counts(rows: DataFrame) -> DataFrame:
    """word_hash, word, n of every distinct word of the rows (training, text); n counts training rows only."""
    def flush(held: list[tuple]) -> pa.RecordBatch:
        hashes = np.concatenate([h for h, *_ in held])
        used = np.concatenate([u for _, u, *_ in held])
        shift = np.concatenate(([0], np.cumsum([len(d) for *_, d in held])[:-1]))
        starts = np.concatenate([s + k for (_, _, s, _, _), k in zip(held, shift)])
        ends = np.concatenate([e + k for (_, _, _, e, _), k in zip(held, shift)])
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=used, minlength=len(distinct)).astype(np.int64)
        text = strings(np.concatenate([d for *_, d in held]), starts[first], ends[first])
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), text, pa.array(n)], ["word_hash", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            found = found_words(batch.column("text"))
            training = batch.column("training").to_numpy(zero_copy_only=False)
            used = np.repeat(training, np.diff(found.rows)).astype(float)
            held.append((found.hashes, used, found.starts, found.ends, found.data))
            size += len(found.hashes)
            if size >= FLUSH_WORDS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    counted = rows.mapInArrow(run, "word_hash long, word string, n long")
    return counted.groupBy("word_hash").agg(F.sum("n").alias("n"), F.max("word").alias("word"))


@dataclass
class Model:
    """Log probabilities of the pieces and of the end, the counts behind the word baseline, and what word arcs give up."""

    logp: np.ndarray
    log_end: float
    ends: int
    tokens: int
    distinct: int
    discount: float

    def word_logs(self, n: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Log probability of words seen n times with the log probabilities of their pieces: the word arc or the pieces."""
        if not self.tokens:
            return pieces
        spare = self.discount * max(0, self.distinct - (self.ends > 0)) / self.tokens
        with np.errstate(divide="ignore"):
            arc = np.log(np.maximum(n - self.discount, 0) / self.tokens)
            return np.logaddexp(arc, pieces + (math.log(spare) if spare else -np.inf))

    def end_log(self) -> float:
        return math.log(self.ends / self.tokens) if self.ends else self.log_end


def learn(words: DataFrame, documents: int, lattice, pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from the word table (word, n) and the number of training documents."""
    spark = words.sparkSession
    first = words.where("n > 0").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    tokens, distinct = (first[0] or 0) + documents, first[1] + (documents > 0)
    discount = first[2] / (first[2] + 2 * first[3]) if first[2] else 0.5  # from the words seen once and twice
    logp, log_end = lattice.value.first_weights(pieces), math.log(0.05)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(logp)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(lattice.value.n_pieces)
            for batch in gathered(batches):
                total += lattice.value.expected(batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float), shared.value)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        found = words.where("n > 0").select("word", "n").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        counts = np.full(lattice.value.n_pieces, PRIOR)
        for row in found.collect():  # a row for each piece of the vocabulary at most
            counts[row.piece] += row.uses
        total = counts.sum() + documents + PRIOR
        logp, log_end = np.log(counts / total), math.log((documents + PRIOR) / total)
    return Model(logp, log_end, documents, int(tokens), int(distinct), discount)


def score(frame: DataFrame, training: Column, key: str = "doc_id", text: str = "text", model_file: str = MODEL_FILE, rounds: int = ROUNDS) -> DataFrame:
    """key, training, n_tokens, n_known, train_tokens, base_score, score, pieces_score of every row, learned from the `training` rows.

    Tokens are words and one end for each text; base_score is the add-one unigram log10 probability of the
    tokens, score that of the lattice with word arcs, pieces_score that of the vocabulary's pieces alone. Null texts are empty (an end alone). Other columns are not read.
    """
    spark = frame.sparkSession
    textkit.limit_batches(spark)
    kind = frame.schema[key].dataType.simpleString()
    rows = frame.select(F.col(key).alias("id"), training.alias("training"), F.coalesce(text, F.lit("")).alias("text"))
    pieces = load(model_file)
    lattice = spark.sparkContext.broadcast(Lattice(pieces))  # bounded by the vocabulary
    words = cut(word_counts(rows.select("training", "text")))
    size = rows.agg(F.sum(F.octet_length("text")), F.sum(F.col("training").cast("int"))).first()
    model = learn(words, size[1] or 0, lattice, pieces, rounds)
    learned = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            value = lattice.value.scores(batch.column("word").to_pylist(), learned.value.logp)
            yield pa.RecordBatch.from_arrays([batch.column("word_hash"), batch.column("n"), pa.array(value)], ["word_hash", "n", "value"])

    rated = words.select("word_hash", "word", "n").mapInArrow(rate, "word_hash long, n long, value double")
    blocks = max(partitions(spark), math.ceil((size[0] or 0) / BLOCK_BYTES))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(partitions(spark), "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                distinct = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), block, np.int32)), pa.array(distinct.view(np.int64))], ["block", "word_hash"])

        for batch in batches:
            found = found_words(batch.column("text"))
            block = np.repeat(batch.column("block").to_numpy(), np.diff(found.rows))
            for b in np.unique(block):
                part = np.unique(found.hashes[block == b])
                held.setdefault(int(b), []).append(part)
                size += len(part)
            if size >= FLUSH_WORDS:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    asked = placed.select("block", "text").mapInArrow(ask, "block int, word_hash long")
    answers = asked.join(rated, "word_hash").repartition(partitions(spark), "block")

    def rows_of(docs: pa.Table, known: pa.Table) -> pa.Table:
        m = learned.value
        order = np.argsort(known.column("word_hash").to_numpy().view(np.uint64), kind="stable")
        hashes = known.column("word_hash").to_numpy().view(np.uint64)[order]
        n, value = known.column("n").to_numpy()[order], known.column("value").to_numpy()[order]
        scale = math.log10(m.tokens + m.distinct + 1)
        base_of, known_of = np.log10(n + 1.0) - scale, (n > 0).astype(float)
        end_base = math.log10(m.ends + 1) - scale
        whole = m.word_logs(n, value) / _LOG10
        out = []
        for batch in docs.to_batches(max_chunksize=textkit.BATCH_ROWS):
            found = found_words(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.rows))
            at = np.searchsorted(hashes, found.hashes)
            total = lambda v: np.bincount(row, weights=v[at] if len(at) else None, minlength=batch.num_rows)  # noqa: B023,E731
            out.append(pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("training"), pa.array(np.diff(found.rows) + 1),
                pa.array(total(known_of).astype(np.int64) + int(m.ends > 0)), pa.array(np.full(batch.num_rows, m.tokens)),
                pa.array(total(base_of) + end_base),
                pa.array(total(whole) + m.end_log() / _LOG10), pa.array((total(value) + m.log_end) / _LOG10),
            ], [key, "training", "n_tokens", "n_known", "train_tokens", "base_score", "score", "pieces_score"]))
        return pa.Table.from_batches(out)

    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        rows_of, f"`{key}` {kind}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, pieces_score double"
    )
