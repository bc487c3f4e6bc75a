import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SF_DIR
from threadtide.llm import align, chunked, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text, first, second, raw):
    """Groups of ids of both tokenizers over space + text, or None where a tokenizer does not give the bytes back."""
    if not text:
        return None
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    want = (" " + text).encode()
    if b"".join(raw[i] for i in a) != want:
        return None
    pieces = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(pieces) != want:
        return None
    groups, at = [], [0, 0]
    held = ([], [])
    streams = ([(i, len(raw[i])) for i in a], [(i, len(p)) for i, p in zip(b, pieces)])
    while streams[0] or streams[1]:
        side = 0 if at[0] <= at[1] and streams[0] else 1
        i, n = streams[side].pop(0)
        held[side].append(i)
        at[side] += n
        if at[0] == at[1]:
            groups.append(held)
            held = ([], [])
    return groups


def brute(rows):
    first, second = Tokenizer.from_file(chunked.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=chunked.PIECE_BPE)
    first.encode_special_tokens = True
    raw = chunked.byte_bpe(chunked.definition(), plain=True).raw
    found = [(key, tokens(text, first, second, raw)) for key, text in rows]
    counts = Counter(p for _, g in found if g for p in {(a, b) for x, y in g for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for key, groups in found:
        links = [(a, b) for x, y in groups or [] for a in x for b in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        out.append((
            key, sum(len(x) for x, _ in groups or []), sum(len(y) for _, y in groups or []), len(groups or []), len(links),
            sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def test_the_given_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_cross_tokenizer_alignment"](spark, SF_DIR)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute([tuple(r) for r in rows])


def test_odd_rows(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 300), ("PART_BYTES", 400), ("SLICE_BLOCKS", 2), ("FAN_IN", 2)):
        monkeypatch.setattr(align, name, value)
    rng = random.Random(6)
    parts = ["the", " ", "  ", "\n", "é", "漢字", "<|endoftext|>", "<s>", "<0x0A>", "▁", "　", "don't", "1234", "😀", "aaaa" * 9, " and", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(120)]
    texts += [None, "", " ", "same words here"] + ["same words here"] * 40 + ["long run " * 3000, "b" * 3000]
    rows = [(rng.choice([None, 3, i, i]), t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, part string")
    got = align.alignment(frame, chunked.definition(), chunked.model())
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert align.alignment(frame.limit(0), chunked.definition(), chunked.model()).count() == 0


def test_the_second_pass_reads_the_ids_of_the_first(spark):
    first, second = chunked.byte_bpe(chunked.definition(), plain=True), chunked.piece_bpe(chunked.model())
    texts = pa.array(["some words, some  more", None, "\x00 <s>", "", "some words \u3000 x 漢字", "aaaa" * 200])
    ids = align.encode(align.cut(texts), first, second)
    again = align.Encoded.from_bytes(ids.to_bytes())
    assert all(np.array_equal(getattr(ids, c), getattr(again, c)) for c in ("a", "n_a", "b", "n_b"))
    with pytest.raises(ValueError):  # the ids of another block, or of its rows in another order
        align.align(texts[::-1], align.cut(texts[::-1]), again, first.lengths, second.lengths)
    none = pa.array([None, ""])
    empty = align.Encoded.from_bytes(align.encode(align.cut(none), first, second).to_bytes())
    assert not align.align(none, align.cut(none), empty, first.lengths, second.lengths).row_good().any()
    frame = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    plan = align.alignment(frame, chunked.definition(), chunked.model())._jdf.queryExecution().analyzed().toString()
    assert "ids#" in plan
