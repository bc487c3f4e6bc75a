"""Public tokenizers over whole texts, each distinct stretch of a batch encoded once.

A text is cut before every space that follows a character other than white space. Neither tokenizer has a token over
such a place: byte-level BPE splits there before it merges, and no piece of the other vocabulary has a space after
another character. So the ids of a text are the ids of its stretches one after another.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadtide.llm import textkit

#: Public vocabulary files; parameters of the operators that use them.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the strings that distinct stretches are joined to for one call.
JOINED = 4000


@dataclass
class Stretches:
    """Distinct stretches of a batch, the code of each stretch in text order, and the first code of each row."""

    distinct: pa.Array
    codes: np.ndarray
    rows: np.ndarray


def stretches(texts: pa.Array, lead: str = "") -> Stretches:
    """The stretches of `lead` + text of every row; texts have no nulls, and a row of no characters has no stretch."""
    if lead:
        texts = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(lead, pa.large_string()))
    offsets, data = textkit.string_buffers(texts)
    if not len(data):
        return Stretches(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    last, before = np.full_like(data, 32), np.full_like(data, 32)
    last[1:], before[2:] = data[:-1], data[:-2]
    cut = (data == 32) & (last > 32) & ~_ends_wide_space(before, last)
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts, len(data)).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    return Stretches(coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets))


def _ends_wide_space(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the last two bytes of a character are those of white space beyond ASCII (or of a few others, which does no harm)."""
    wide = (before == 0xC2) & ((last == 0x85) | (last == 0xA0))
    wide |= (before == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)) & (last >= 0x80)
    return wide | ((before == 0x9A) & (last == 0x80)) | ((before == 0x81) & (last == 0x9F))


class Coder:
    """ids of many stretches at once; `raw` has the bytes of every id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], raw: list[bytes]):
        self.encode, self.raw = encode, raw
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]

    def many(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all stretches in a row, and the first id of each (one more entry at the end).

        Stretches with a space before and none behind are joined and encoded together; where an id of such a string does
        not end with a stretch or its bytes are other ones, its stretches are encoded one by one.
        """
        offsets, data = textkit.string_buffers(distinct)
        if not len(distinct):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        last = offsets[1:] - 1
        lone = (data[offsets[:-1]] != 32) | (data[last] <= 32) | _ends_wide_space(data[np.maximum(last - 1, 0)], data[last])
        sizes = np.zeros(len(distinct), np.int64)
        together = np.flatnonzero(~lone)
        flat, counts, failed = self._together(distinct.take(pa.array(together)))
        sizes[together] = counts
        apart = np.sort(np.concatenate((np.flatnonzero(lone), together[failed])))
        texts = distinct.take(pa.array(apart)).to_pylist()
        found = [np.asarray(ids, np.int32) for ids in self.encode(texts)] if texts else []
        sizes[apart] = [len(f) for f in found]
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(int(firsts[-1]), np.int32)
        settled = np.zeros(len(distinct), bool)
        settled[together] = True
        settled[together[failed]] = False
        mask = np.repeat(settled, sizes)
        out[mask] = flat
        out[~mask] = np.concatenate(found) if found else np.zeros(0, np.int32)
        return out, firsts

    def _together(self, chosen: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of the stretches that could be encoded together, the number of each one's (0 where not), and the places of the others."""
        offsets, data = textkit.string_buffers(chosen)
        n = len(chosen)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        edges = np.unique(np.concatenate(([0], np.searchsorted(offsets, np.arange(0, int(offsets[-1]), JOINED)), [n])))
        raw = data.tobytes()
        strings = [raw[a:b] for a, b in zip(offsets[edges[:-1]], offsets[edges[1:]])]
        parts, counts, failed = [], np.zeros(n, np.int64), []
        for low, high, string, ids in zip(edges, edges[1:], strings, self.encode([s.decode() for s in strings])):
            ids = np.asarray(ids, np.int32)
            ends, wanted = np.cumsum(self.lengths[ids]), offsets[low + 1 : high + 1] - offsets[low]
            at = np.searchsorted(ends, wanted)
            if at[-1] < len(ends) and np.array_equal(ends[at], wanted) and at[-1] == len(ends) - 1 and self.bytes_of(ids).tobytes() == string:
                parts.append(ids)
                counts[low:high] = np.diff(at, prepend=-1)
            else:
                failed.append(np.arange(low, high))
        join = lambda arrays, kind: np.concatenate(arrays) if arrays else np.zeros(0, kind)
        return join(parts, np.int32), counts, join(failed, np.int64)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        sizes = self.lengths[ids]
        if not len(ids):
            return np.zeros(0, np.uint8)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return self.pool[np.arange(int(sizes.sum())) + np.repeat(self.first[ids] - first, sizes)]


def _byte_alphabet() -> dict[str, int]:
    """Byte of every character that byte-level vocabularies write bytes as: printable Latin-1 stands for itself, the rest follows 255."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def definition(path: str = BYTE_BPE) -> str:
    """The JSON of a byte-level tokenizer."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def model(path: str = PIECE_BPE) -> bytes:
    """The bytes of a sentencepiece model."""
    with open(path, "rb") as file:
        return file.read()


def byte_bpe(definition: str, plain: bool) -> Coder:
    """A byte-level tokenizer from its JSON text; `plain`: strings of special tokens inside texts are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = plain
    alphabet = _byte_alphabet()
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    added = {t["id"] for t in json.loads(definition)["added_tokens"]}
    raw = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        raw[i] = token.encode() if i in added else bytes(alphabet[c] for c in token)
    return Coder(lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)], raw)


def piece_bpe(model: bytes) -> Coder:
    """A sentencepiece tokenizer from its file's bytes, for stretches that begin with the space that it adds itself."""
    import sentencepiece

    from threadtide.llm.pieces import SPACE

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    raw = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        raw.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(SPACE, " ").encode())

    def encode(texts: list[str]) -> list[list[int]]:
        found = processor.encode([t[1:] for t in texts], num_threads=1)
        return [ids or [processor.piece_to_id(SPACE)] for ids in found]  # no space is added to nothing

    return Coder(encode, raw)


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Tables of about `size` bytes of text: the more text, the more often a stretch repeats; a longer row is a table of its own."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in textkit.sliced(batches):
        if not batch.num_rows:
            continue
        held.append(batch)
        total += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)
