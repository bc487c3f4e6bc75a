import random

import pytest

from threadtide.llm import jaccard

DOCS = "/root/testdata/sf0.001/documents.parquet"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not a and not b or bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def brute(rows):
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = {i: 0 for i, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if alike(a, b):
                n[i] += 1
                n[j] += 1
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    least = {}
    for i, a in sets:
        least[frozenset(a)] = min(i, least.get(frozenset(a), i))
    return sorted((i, least[frozenset(a)], top(i), n[i]) for i, a in sets)


def result(df):
    return sorted(tuple(r) for r in df.where("doc_id is not null").select("doc_id", "copy_of", "class_id", "n_links").collect())


def edited(words, rng, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture
def rows():
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    out = [(i, edited(base, rng, rng.randrange(12))) for i in range(60)]
    out += [(100 + i, " ".join(f"v{rng.randrange(200)}" for _ in range(rng.randrange(40)))) for i in range(60)]
    out += [(200 + i, out[rng.randrange(60)][1]) for i in range(30)]
    return out + [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "One  two"), (None, "one two"), (305, "x " * 30_000)]


def test_links_and_classes_match_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.jaccard_join(frame)) == brute(rows)


def test_blocks_of_a_large_bucket_lose_no_link(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard.meetings, "__defaults__", (7,))
    assert result(jaccard.jaccard_join(frame)) == brute(rows)


def test_driver_documents(spark):
    frame = spark.read.parquet(DOCS)
    assert result(jaccard.jaccard_join(frame)) == brute([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])


def test_null_keys_clashing_columns_and_empty_tables(spark):
    frame = spark.createDataFrame(
        [(1, "a b c", "x", 1), (None, "a b c", "y", 2), (2, "a b c", "z", 3)], "doc_id long, text string, rep string, bands int"
    )
    found = {(r.doc_id, r.copy_of, r.class_id, r.n_links) for r in jaccard.jaccard_join(frame).collect()}
    assert found == {(1, 1, 1, 1), (2, 1, 1, 1), (None, None, None, 0)}
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns and sorted(r.rep for r in kept.collect()) == ["x", "y"]
    assert jaccard.jaccard_join(frame.limit(0)).count() == 0 and jaccard.keep_one(frame.limit(0)).count() == 0


def test_repeated_rows_stay_once(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(frame).collect()) == [1, 2]


def test_bands_reach_the_recall():
    bands = jaccard.choose_bands(0.8, 0.9998)
    assert 1 - (1 - 0.8**bands.rows) ** bands.count >= 0.9998
    assert 1 - (1 - 0.8**bands.rows) ** (bands.count - 1) < 0.9998


def test_plan_has_no_pairs(spark):
    plan = jaccard.jaccard_join(spark.read.parquet(DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
