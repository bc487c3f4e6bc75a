"""SentencePiece vocabularies: pieces, scores and byte fallback, as plain tables that fit a broadcast."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Where the public vocabulary files lie; a parameter of every operator that needs one.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 in a text; as a lone surrogate it occurs in no valid text.
LITERAL = "\udfff"
#: A character that is no piece costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass
class Pieces:
    """ids and scores by piece, the bytes of every id, and the places where every segmentation has a boundary."""

    names: list[str]
    scores: list[float]
    byte_ids: dict[int, int]
    ids: dict[str, int]
    raw: list[bytes] = field(init=False)
    prefixes: set[str] = field(init=False)
    longest: int = field(init=False)
    unknown: float = field(init=False)
    cut: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        by_id = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.raw = [b""] * len(self.names)
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for i, value in by_id.items():
            self.raw[i] = value
        self.prefixes = {piece[:k] for piece in self.ids for k in range(1, len(piece) + 1)}
        self.longest = max(map(len, self.ids), default=1)
        used = [self.scores[i] for i in self.ids.values() if self.scores[i] > -1e8]
        self.unknown = min(used, default=0.0) - UNKNOWN_PENALTY
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Segments that no piece crosses: before runs of the space mark (if no piece has one inside), around lone controls."""
        inside = {c for piece in self.ids if len(piece) > 1 for c in piece}
        alone = "".join(chr(c) for c in range(32) if chr(c) not in inside)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            return re.compile(f"[{alone}]|[^{alone}]+")
        return re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone}]")

    def normalise(self, text: str) -> str:
        """The text as the lattice sees it: one leading space mark, spaces as marks, nothing else changed."""
        return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in (SPACE if char == LITERAL else char).encode()]


def load(model_file: str = MODEL_FILE) -> Pieces:
    """The vocabulary of a model file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    byte_ids = {int(names[i][3:5], 16): i for i in range(len(names)) if model.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError(f"{model_file} has no byte fallback")
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(names))]
    ids = {name: i for i, name in enumerate(names) if not special[i]}
    return Pieces(names, [model.get_score(i) for i in range(len(names))], byte_ids, ids)
