"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search keeps scores for one window of the longest piece; ids are committed as soon as the back
paths of all positions in that window meet in one boundary. Where no piece can cross (before a space
mark, at a line break) the paths always meet, so texts are cut there: each distinct stretch of a table is
searched once, the short ones of at most a window or so together, position by position in step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from threadtide.llm import chunked, lockstep, textkit
from threadtide.llm.pieces import LITERAL, MODEL_FILE, SPACE, Pieces, load

#: Segments that one task remembers in each of two generations.
MEMO = 150_000
#: Positions between two looks for a common boundary; twice as many as are open if the last look found none.
CHECK_EVERY = 64
#: Longer segments are not remembered.
MEMO_CHARS = 64
#: Text that is encoded at a time: each distinct stretch of it is searched once.
TASK_BYTES = 3 << 20


def search(text: str, pieces: Pieces) -> list[int]:
    """ids of the best segmentation of a normalised text; ties go to the longer last piece."""
    ids, scores, prefixes, longest = pieces.ids, pieces.scores, pieces.prefixes, pieces.longest
    out: list[int] = []
    base, n = 0, len(text)  # everything before base is committed
    best: list[float] = [0.0]
    back: list[tuple[int, int]] = [(0, -1)]  # start and id of the piece that ends here, counted from base
    look = CHECK_EVERY + longest
    for at in range(n):
        here = at - base
        score = best[here]
        if len(best) <= here + longest:
            grow = here + longest + 1 - len(best)
            best.extend([float("-inf")] * grow)
            back.extend([(0, -1)] * grow)
        if text[at] not in ids and score + pieces.unknown > best[here + 1]:
            best[here + 1], back[here + 1] = score + pieces.unknown, (here, -1)
        for end in range(at + 1, min(at + longest, n) + 1):
            part = text[at:end]
            if part not in prefixes:
                break
            piece = ids.get(part)
            if piece is not None and score + scores[piece] > best[end - base]:
                best[end - base], back[end - base] = score + scores[piece], (here, piece)
        if here >= look:
            common = _meeting(back, here + 1, min(here + longest, n - base), best)
            look = here - common + CHECK_EVERY if common else 2 * here  # runs of one piece may not meet before the end
            if common:
                out += _trace(text, base, back, common, pieces)
                base += common
                best = best[common:]
                back = [(start - common, piece) for start, piece in back[common:]]
    return out + _trace(text, base, back, n - base, pieces) if n else out


def search_short(text: str, pieces: Pieces) -> list[int]:
    """The same best segmentation for a text that fits one window: no commits are needed."""
    ids, scores, prefixes, n = pieces.ids, pieces.scores, pieces.prefixes, len(text)
    best = [float("-inf")] * (n + 1)
    back = [(0, -1)] * (n + 1)
    best[0] = 0.0
    for at in range(n):
        score = best[at]
        if text[at] not in ids and score + pieces.unknown > best[at + 1]:
            best[at + 1], back[at + 1] = score + pieces.unknown, (at, -1)
        for end in range(at + 1, n + 1):
            part = text[at:end]
            piece = ids.get(part)
            if piece is not None:
                if score + scores[piece] > best[end]:
                    best[end], back[end] = score + scores[piece], (at, piece)
            elif part not in prefixes:
                break
    return _trace(text, 0, back, n, pieces)


def _meeting(back: list[tuple[int, int]], first: int, last: int, best: list[float]) -> int:
    """The last boundary that lies on the back paths of all reached positions from `first` to `last`."""
    open_ = bytearray(last + 1)
    for p in range(first, last + 1):
        open_[p] = best[p] > float("-inf")
    count = sum(open_[first:])
    for p in range(last, 0, -1):
        if open_[p]:
            if count == 1:
                return p
            start = back[p][0]
            count -= open_[start]  # two paths become one
            open_[start] = 1
    return 0


def _trace(text: str, base: int, back: list[tuple[int, int]], end: int, pieces: Pieces) -> list[int]:
    found: list[int] = []
    while end > 0:
        start, piece = back[end]
        if piece >= 0:
            found.append(piece)
        else:
            found += pieces.fallback(text[base + start])[::-1]
        end = start
    return found[::-1]


class Encoder:
    """Texts to ids and back; remembers recent segments in two generations of bounded size."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.young, self.old, self.trie = pieces, {}, {}, None
        self.lengths = np.array([len(r) for r in pieces.raw], np.int64)

    def encode(self, text: str) -> list[int]:
        return self.search_all(self.pieces.normalise(text))

    def search_all(self, normal: str) -> list[int]:
        """ids of a normalised text, segment by segment."""
        out: list[int] = []
        young = self.young
        for segment in self.pieces.cut.findall(normal):
            found = young.get(segment)
            if found is None:
                found = self.old.get(segment)
                if found is None:
                    found = (search_short if len(segment) <= MEMO_CHARS else search)(segment, self.pieces)
                if len(segment) <= MEMO_CHARS:
                    if len(young) >= MEMO:
                        self.old, self.young = young, {}
                        young = self.young
                    young[segment] = found
            out += found
        return out

    def table(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts in a row, the first id of each (one more entry at the end), and whether decoding gives each text back.

        Where no piece has a space mark after another character, the distinct stretches of all texts are searched once,
        all short ones in step.
        """
        if any(SPACE in piece.lstrip(SPACE) for piece in self.pieces.ids):
            rows = [self.encode(t) for t in texts.to_pylist()]
            same = np.array([self.decode(ids) == t for ids, t in zip(rows, texts.to_pylist())], bool)
            return np.array([i for ids in rows for i in ids], np.int32), np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64))), same
        cut = chunked.stretches(texts, lead=" ")
        stretches = cut.distinct.to_pylist()
        normal = [s.replace(SPACE, LITERAL).replace(" ", SPACE) for s in stretches]
        if self.trie is None:
            self.trie = lockstep.Trie(self.pieces)
        long = np.array([len(s) > MEMO_CHARS for s in normal], bool)
        short_ids, short_firsts = lockstep.search_many(["" if far else s for s, far in zip(normal, long)], self.pieces, self.trie)
        sizes = np.diff(short_firsts)
        rest = {int(i): self.search_all(normal[i]) for i in np.flatnonzero(long)}
        for i, ids in rest.items():
            sizes[i] = len(ids)
        flat = np.empty(int(sizes.sum()), np.int32)
        mine = np.repeat(long, sizes)
        flat[~mine] = short_ids
        flat[mine] = [i for ids in rest.values() for i in ids]
        firsts = np.concatenate(([0], np.cumsum(sizes)))
        back = self._gives_back(flat, firsts, cut.distinct)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)  # the leading space alone is no text
        codes = cut.codes[~np.repeat(empty, np.diff(cut.rows))]
        rows = np.concatenate(([0], np.cumsum(np.where(empty, 0, np.diff(cut.rows)))))
        spread = sizes[codes]
        before = np.concatenate(([0], np.cumsum(spread)))
        bad = np.concatenate(([0], np.cumsum(~back[codes])))
        return flat[np.arange(int(before[-1])) + np.repeat(firsts[codes] - before[:-1], spread)], before[rows], bad[rows[1:]] == bad[rows[:-1]]

    def _gives_back(self, ids: np.ndarray, firsts: np.ndarray, stretches: pa.Array) -> np.ndarray:
        """Which stretches' ids decode to exactly their bytes."""
        offsets, data = textkit.string_buffers(stretches)
        raw = b"".join(map(self.pieces.raw.__getitem__, ids.tolist()))
        ends = np.concatenate(([0], np.cumsum(self.lengths[ids])))[firsts]
        same = np.diff(ends) == np.diff(offsets)
        made = np.frombuffer(raw, np.uint8)[np.repeat(same, np.diff(ends))]
        given = data[np.repeat(same, np.diff(offsets))]
        same[np.repeat(np.flatnonzero(same), np.diff(offsets)[same])[made != given]] = False
        return same

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(
    frame: DataFrame, key: str = "doc_id", text: str = "text", model_file: str = MODEL_FILE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """key, the columns of `keep`, ids, n_tokens and round_trip (whether decoding gives the text back) of every row.

    A null text counts as empty and has no ids. Other columns are not read, so their names cannot clash.
    """
    textkit.limit_batches(frame.sparkSession)
    shared = frame.sparkSession.sparkContext.broadcast(load(model_file))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for table in chunked.gathered(batches, text, TASK_BYTES):
            flat, firsts, same = encoder.table(textkit.plain(table.column(text), lower=False))
            ids = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(flat))
            columns = [*(table.column(c).combine_chunks() for c in (key, *keep)), ids, pa.array(np.diff(firsts).astype(np.int32)), pa.array(same)]
            made = pa.RecordBatch.from_arrays(columns, [key, *keep, "ids", "n_tokens", "round_trip"])
            yield from textkit.sliced(iter([made]))

    fixed = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in (key, *keep))
    columns = list(dict.fromkeys((key, *keep, text)))
    return frame.select(*columns).mapInArrow(run, f"{fixed}, ids array<int>, n_tokens int, round_trip boolean")


def decode(frame: DataFrame, key: str = "doc_id", ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """key and text of every row of ids; a null list gives an empty text."""
    shared = frame.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in textkit.sliced(batches, 200):
            texts = [encoder.decode(row or []) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return frame.select(key, ids).mapInArrow(run, f"`{key}` {frame.schema[key].dataType.simpleString()}, text string")
