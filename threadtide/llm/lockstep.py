"""Best segmentations of many short segments at once: the Viterbi search of all of them runs position by position in step.

Pieces are found by walking a trie from every character at the same time; the trie's edges are one hash table of arrays.
"""

from __future__ import annotations

import numpy as np

from threadtide.llm.pieces import Pieces

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Characters of the segments that are searched in step at a time: their edges take about 300 bytes a character.
BLOCK_CHARS = 100_000


class Trie:
    """Edges (state, character) to state as an open hash table, and the piece that ends in each state (-1: none)."""

    def __init__(self, pieces: Pieces):
        states: dict[str, int] = {"": 0}
        for prefix in sorted(pieces.prefixes, key=len):
            states[prefix] = len(states)
        names = list(states)[1:]
        keys = np.array([(states[n[:-1]] << 21) | ord(n[-1]) for n in names], np.uint64)
        self.piece = np.full(len(states), -1, np.int64)
        for name, i in pieces.ids.items():
            self.piece[states[name]] = i
        self.bits = max(4, int(len(names) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.next = np.full(size, np.iinfo(np.uint64).max, np.uint64), np.zeros(size, np.int64)
        left, at = np.arange(len(names)), self._home(keys)
        while len(left):  # of the keys that want a free place, one gets it; the rest look at the next
            free = self.keys[at] == np.iinfo(np.uint64).max
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.next[at[won]] = left[won] + 1
            left, at = left[~won], (at[~won] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states behind the edges, 0 where there is none."""
        keys = (states.astype(np.uint64) << np.uint64(21)) | chars.astype(np.uint64)
        out, at, left = np.zeros(len(keys), np.int64), self._home(keys), np.arange(len(keys))
        while len(left):
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.next[at[hit]]
            go = ~hit & (held != np.iinfo(np.uint64).max)
            left, at = left[go], (at[go] + 1) & (len(self.keys) - 1)
        return out


def search_many(segments: list[str], pieces: Pieces, trie: Trie, block: int = BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """ids of the best segmentation of every segment in a row, and the first id of each (one more entry at the end).

    The same segmentations as a search one by one: ties go to the longer last piece. Segments are searched
    in blocks of about `block` characters, so memory does not grow with their number but by the ids.
    """
    ends = np.cumsum([len(s) for s in segments], dtype=np.int64)
    edges = np.unique(np.searchsorted(ends, np.arange(block, int(ends[-1]) if len(ends) else 0, block)) + 1).tolist()
    found = [_search_block(segments[a:b], pieces, trie) for a, b in zip([0, *edges], [*edges, len(segments)])]
    sizes = np.concatenate([np.diff(firsts) for _, firsts in found])
    return np.concatenate([ids for ids, _ in found]), np.concatenate(([0], np.cumsum(sizes)))


def _search_block(segments: list[str], pieces: Pieces, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """`search_many` of one block."""
    lengths = np.array([len(s) for s in segments], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int32), np.zeros(len(segments) + 1, np.int64)
    chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    firsts = np.concatenate(([0], np.cumsum(lengths)))
    owner = np.repeat(np.arange(len(segments)), lengths)
    ends = firsts[1:][owner]
    scores = np.asarray(pieces.scores, np.float64)
    starts, sizes, found = [], [], []
    alive, states = np.arange(len(chars)), np.zeros(len(chars), np.int64)
    single = np.full(len(chars), False)
    for k in range(1, pieces.longest + 1):
        states = trie.step(states, chars[alive + k - 1])
        piece = trie.piece[states]
        hit = (states > 0) & (piece >= 0)
        starts.append(alive[hit])
        sizes.append(np.full(int(hit.sum()), k))
        found.append(piece[hit])
        if k == 1:
            single[alive[hit]] = True
        on = (states > 0) & (alive + k < ends[alive])
        alive, states = alive[on], states[on]
        if not len(alive):
            break
    unknown = np.flatnonzero(~single)
    start = np.concatenate((*starts, unknown))
    size = np.concatenate((*sizes, np.ones(len(unknown), np.int64)))
    piece = np.concatenate((*found, np.full(len(unknown), -1)))
    weight = np.where(piece >= 0, scores[np.maximum(piece, 0)], pieces.unknown)
    place = start - firsts[owner[start]]
    order = np.argsort(place, kind="stable")
    start, size, piece, weight = start[order], size[order], piece[order], weight[order]
    edges = np.searchsorted(place[order], np.arange(int(lengths.max()) + 1))
    node = start + owner[start]  # every segment has one more node than characters
    best = np.full(len(chars) + len(segments), -np.inf)
    best[firsts[:-1] + np.arange(len(segments))] = 0.0
    back_size, back_piece = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
    for low, high in zip(edges, edges[1:]):
        here, there = node[low:high], node[low:high] + size[low:high]
        score = best[here] + weight[low:high]
        better = score > best[there]
        there = there[better]
        best[there] = score[better]
        back_size[there], back_piece[there] = size[low:high][better], piece[low:high][better]
    # back along the paths of all segments in step
    at, segment = (firsts[1:] + np.arange(len(segments)))[lengths > 0], np.flatnonzero(lengths)
    path_segment, path_piece, path_char, step = [], [], [], []
    while len(at):
        path_segment.append(segment)
        path_piece.append(back_piece[at])
        at = at - back_size[at]
        path_char.append(at - segment)  # the character that an unknown one stands for
        step.append(np.full(len(at), len(step)))
        go = at > firsts[segment] + segment
        at, segment = at[go], segment[go]
    path_segment, path_piece, path_char, step = (np.concatenate(v) for v in (path_segment, path_piece, path_char, step))
    order = np.lexsort((-step, path_segment))
    path_segment, path_piece, path_char = path_segment[order], path_piece[order], path_char[order]
    counts = np.ones(len(path_piece), np.int64)
    odd = np.flatnonzero(path_piece < 0)
    spelled = {c: pieces.fallback(chr(c)) for c in np.unique(chars[path_char[odd]]).tolist()}
    bytes_of = [spelled[c] for c in chars[path_char[odd]].tolist()]
    counts[odd] = [len(b) for b in bytes_of]
    out = np.repeat(path_piece, counts)
    out[np.repeat(path_piece < 0, counts)] = [i for b in bytes_of for i in b]
    sums = np.bincount(path_segment, counts, len(segments)).astype(np.int64)
    return out.astype(np.int32), np.concatenate(([0], np.cumsum(sums)))
