import math
import re
import zlib

import numpy as np
import pytest

from threadtide.llm import lattice, pieces

VOCABULARY = pieces.load()
NET = lattice.Lattice(VOCABULARY)
LOGP = NET.first_weights(VOCABULARY)


def parts(word, at=0):
    """All segmentations of a spelt word: lists of (log weight, piece ids)."""
    if at == len(word):
        yield 0.0, ()
        return
    for end in range(at + 1, len(word) + 1):
        part = word[at:end]
        if part in VOCABULARY.ids:
            mine = (VOCABULARY.ids[part],)
        elif end == at + 1:
            mine = tuple(VOCABULARY.byte_ids[b] for b in ("▁" if part == pieces.LITERAL else part).encode())
        else:
            continue
        for weight, rest in parts(word, end):
            yield weight + sum(LOGP[i] for i in mine), mine + rest


WORDS = ["the", "thanedble,", "a", "é", "漢字x", "😀", "▁", "x▁y", "onhe", "idiot", "réeux", "aaaa"]


def test_forward_sums_all_segmentations():
    want = [math.log(sum(math.exp(w) for w, _ in parts(NET.spell(word)))) for word in WORDS]
    assert np.allclose(NET.scores(WORDS, LOGP), want, atol=1e-9)


def test_expected_uses_match_enumeration():
    counts = np.arange(1, len(WORDS) + 1, dtype=float)
    want = np.zeros(NET.n_pieces)
    for word, n in zip(WORDS, counts):
        found = list(parts(NET.spell(word)))
        total = sum(math.exp(w) for w, _ in found)
        for w, ids in found:
            for i in ids:
                want[i] += n * math.exp(w) / total
    assert np.allclose(NET.expected(WORDS, counts, LOGP), want, atol=1e-9)


def test_long_words_stay_finite():
    got = NET.scores(["x" * 20_000, "é" * 300], LOGP)
    assert np.isfinite(got).all() and (got < 0).all()


def brute(rows):
    tokens = {k: re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for k, (_, t) in enumerate(rows)}
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count, ends = {}, sum(not h for h in held)
    for k in tokens:
        for w in [] if held[k] else tokens[k]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    out = []
    for k, (i, _) in enumerate(rows):
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens[k]) + math.log10((ends + 1) / (n + v + 1))
        known = sum(w in count for w in tokens[k]) + (ends > 0)
        out.append((i, held[k], len(tokens[k]) + 1, known, n, round(base, 6)))
    return out


@pytest.mark.parametrize("blocks", [None, 2000])
def test_counts_and_base_match_brute_force(spark, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(lattice, "BLOCK_BYTES", blocks)
        monkeypatch.setattr(lattice, "FLUSH_WORDS", 500)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, "THE the\x0bthe É é"), (None, "of the"), (1004, "x" * 30_000), (5, rows[5][1])]
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n string, block int")
    got = lattice.score(made, ~lattice.held_out()).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(((r.doc_id, not r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=order) == sorted(brute(rows), key=order)
    assert all(r.score < 0 and math.isfinite(r.score) and math.isfinite(r.pieces_score) for r in got)
    if blocks is None:  # the learned pieces beat bytes by far, and word arcs help on texts that learning has not seen
        unseen = [r for r in got if not r.training and r.doc_id is not None and r.doc_id < 1000]
        assert sum(r.score for r in unseen) > sum(r.pieces_score for r in unseen)


def test_probabilities_of_tokens_sum_to_at_most_one(spark):
    made = spark.createDataFrame([(i, "a b c a b a") for i in range(20)], "doc_id long, text string")
    words = lattice.word_counts(made.selectExpr("true training", "text"))
    model = lattice.learn(words, 20, spark.sparkContext.broadcast(NET), VOCABULARY)
    assert abs(np.exp(model.logp).sum() + math.exp(model.log_end) - 1) < 1e-9
    names = [r.word for r in words.collect()]
    logs = model.word_logs(np.array([r.n for r in words.collect()], float), NET.scores(names, model.logp))
    assert 0.5 < np.exp(logs).sum() + math.exp(model.end_log()) <= 1 + 1e-9


def test_empty_and_untrained_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.score(none, ~lattice.held_out()).count() == 0
    from pyspark.sql import functions as F

    one = lattice.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (3, 0, 0, 0.0) and one.score < 0
