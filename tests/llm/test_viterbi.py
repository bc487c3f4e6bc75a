import random

import pytest

from tests.conftest import SF_DIR
from threadtide.llm import pieces, queries, viterbi

VOCABULARY = pieces.load()
BYTES = set(VOCABULARY.byte_ids.values())


def best_total(text):
    """Largest sum of scores over all segmentations, by the plain recursion over all starts."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - VOCABULARY.longest), end):
            part = text[start:end]
            score = VOCABULARY.scores[VOCABULARY.ids[part]] if part in VOCABULARY.ids else VOCABULARY.unknown if end - start == 1 else None
            if score is not None:
                best[end] = max(best[end], best[start] + score)
    return best[-1]


def total(ids, text):
    unknown = sum(c not in VOCABULARY.ids for c in text)
    return sum(VOCABULARY.scores[i] for i in ids if i not in BYTES) + unknown * VOCABULARY.unknown


def sample(rng, n):
    return "".join(rng.choice(["th", "er", "an", " ", "ing", "é", "漢", "😀", "▁", "\n", "aaaa", "  ", "x"]) for _ in range(n))


def test_the_best_segmentation_is_found():
    rng, encoder = random.Random(1), viterbi.Encoder(VOCABULARY)
    for _ in range(150):
        text = sample(rng, rng.randrange(0, 150))
        normal = VOCABULARY.normalise(text)
        ids = encoder.encode(text)
        assert encoder.decode(ids) == text
        assert ids == viterbi.search(normal, VOCABULARY)  # segments and memory change nothing
        if normal:
            assert total(ids, normal) == pytest.approx(best_total(normal), rel=1e-9)


def test_stretches_in_step_change_nothing(spark):
    import pyarrow as pa

    rng, encoder = random.Random(3), viterbi.Encoder(VOCABULARY)
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()][:60]
    texts += [sample(rng, rng.randrange(0, 90)) for _ in range(200)] + ["", " ", "▁", "\x00", "x" * 300, "漢" * 70, "a\u3000 b"]
    ids, firsts, same = encoder.table(pa.array(texts))
    assert same.all() and len(firsts) == len(texts) + 1
    for text, low, high in zip(texts, firsts, firsts[1:]):
        assert ids[low:high].tolist() == viterbi.search(VOCABULARY.normalise(text), VOCABULARY)


def test_blocks_of_segments_bound_the_memory_and_change_nothing():
    import tracemalloc

    from threadtide.llm import lockstep

    rng, trie = random.Random(4), lockstep.Trie(VOCABULARY)
    some = ["", *(VOCABULARY.normalise(sample(rng, rng.randrange(0, 12))) for _ in range(300)), "", ""]
    whole = lockstep.search_many(some, VOCABULARY, trie)
    for block in (1, 7, 500):
        for made, wanted in zip(lockstep.search_many(some, VOCABULARY, trie, block=block), whole):
            assert made.tolist() == wanted.tolist()
    assert lockstep.search_many([], VOCABULARY, trie)[1].tolist() == [0]
    many = [f"▁then{i}thing" for i in range(80_000)]  # about 1.2 million characters
    tracemalloc.start()
    try:
        lockstep.search_many(many, VOCABULARY, trie)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


def test_commits_change_nothing_and_keep_the_window_short(monkeypatch):
    rng = random.Random(2)
    words = "".join(sample(rng, 400).split())
    whole = viterbi.search_short(words, VOCABULARY)
    for every in (1, 7, 64):
        monkeypatch.setattr(viterbi, "CHECK_EVERY", every)
        assert viterbi.search(words, VOCABULARY) == whole
    longest = []
    trace = viterbi._trace
    monkeypatch.setattr(viterbi, "CHECK_EVERY", 16)
    monkeypatch.setattr(viterbi, "_trace", lambda text, base, back, end, p: longest.append(len(back)) or trace(text, base, back, end, p))
    viterbi.search(words * 20, VOCABULARY)
    assert len(longest) > 100 and max(longest) < 400


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(viterbi, "MEMO", 50)
    encoder, plain = viterbi.Encoder(VOCABULARY), viterbi.Encoder(VOCABULARY)
    text = " ".join(f"w{i % 300}" for i in range(2000))
    assert encoder.encode(text) == plain.encode(text)
    assert len(encoder.young) <= 50 and len(encoder.old) <= 50


def test_every_document_makes_the_round_trip(spark):
    got = queries.QUERIES["op3_sentencepiece"](spark, SF_DIR)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)
    assert {r.doc_id: r.text for r in viterbi.decode(got).collect()} == texts


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "  a  "), (None, "▁ ▁"), (5, "a" * 200_000), (6, "\u0000\t\r\n"), (2, ""), (7, "￾\U0010ffff")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, n_tokens string")
    got = viterbi.encode(frame)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and got.where("round_trip").count() == len(rows)
    back = sorted(((r.doc_id or 0), r.text) for r in viterbi.decode(got).collect())
    assert back == sorted(((i or 0), t or "") for i, t in rows)
    assert viterbi.encode(frame.limit(0)).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert viterbi.decode(null).first().text == ""
