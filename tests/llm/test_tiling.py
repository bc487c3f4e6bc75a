import random

import numpy as np
import pyarrow as pa

from threadtide.llm import textkit, tiling


def brute_tiles(p, t, least):
    """The textbook loop: longest common unmarked run first; ties by place in p, then in t."""
    pm, tm, out = [False] * len(p), [False] * len(t), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not pm[i + k] and not tm[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        pm[i : i + k] = tm[j : j + k] = [True] * k
        out.append((i, j, k))


def test_tiles_match_the_textbook_loop():
    rng = random.Random(3)
    for _ in range(120):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 24))]
        t = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        got = tiling.tiles(textkit.mix64(np.array(p)), textkit.mix64(np.array(t)), 3)
        assert sorted(got) == sorted(brute_tiles(p, t, 3))


def brute_cover(item, text, least):
    least = min(least, len(item))
    return sum(k for _, _, k in brute_tiles(item, text, least)) / len(item)


def test_find_matches_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "!!"), (93, items[3][1])]
    docs = []
    for i in range(80):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        if i % 2:
            source = items[rng.randrange(25)][1].split()
            cut = rng.randrange(len(source) + 1)
            words[5:5] = source[cut:] + ["between"] + source[:cut]  # reordered
        docs.append((i, " ".join(words).upper() + "."))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, "w1 " * 40_000)]
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = tiling.item_blocks(bench)
    got = {(r.doc_id, r.item_id): r for r in tiling.find(frame, blocks).collect()}
    want = {}
    for i, t in docs:
        for j, p in items:
            p = (p or "").replace("!", "").split()
            if p and i != 502:
                c = brute_cover(p, (t or "").lower().replace(".", "").split(), tiling.LEAST)
                if c >= tiling.THRESHOLD:
                    want[i, j] = c
    assert {k for k in got if k[0] != 502} == set(want)
    assert all(abs(got[k].coverage - c) < 1e-9 for k, c in want.items())
    assert all(sum(s.words for s in r.spans) == r.tiled_words for r in got.values())
    kept = tiling.keep_clean(frame, blocks)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_blocks_of_a_large_benchmark_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted((r.doc_id, r.item_id, r.coverage) for r in tiling.find(docs, tiling.item_blocks(bench)).collect())
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 300)
    blocks = tiling.item_blocks(bench)
    assert len(blocks) > 2
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in tiling.find(docs, blocks).collect()) == one


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert tiling.find(docs, tiling.item_blocks(none)).count() == 0
    assert tiling.keep_clean(docs, tiling.item_blocks(none)).count() == 1
    assert tiling.find(docs.limit(0), tiling.item_blocks(none)).count() == 0


def test_words_are_hashed_alike_in_any_batch():
    texts = ["a b  c", "", None, "c b a", "x" * 300]
    whole = textkit.words(pa.array(texts))
    parts = [textkit.words(pa.array([t], pa.string())) for t in texts]
    assert np.array_equal(whole.hashes, np.concatenate([p.hashes for p in parts]))
