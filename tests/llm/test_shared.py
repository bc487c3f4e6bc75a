import random

import numpy as np
import pyarrow as pa

from threadtide.llm import textkit
from threadtide.llm.components import components


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    edges += [(7, 7), (None, 3), (4, None), *edges[:5]]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_shingles():
    found = textkit.words(pa.array(["a b c d e f", "a b", None, "b c d e f"]))
    grams, rows = textkit.shingles(found, 5)
    assert list(rows) == [0, 2, 3, 3, 4] and grams[1] == grams[3] and len(np.unique(grams)) == 3


def test_slices_of_columns_are_read_in_place():
    whole = pa.array(["x y", "é z", None, "last one"])
    a, b = textkit.words(whole.slice(1, 3)), textkit.words(pa.array(["é z", None, "last one"]))
    assert np.array_equal(a.hashes, b.hashes) and np.array_equal(a.rows, b.rows)
    wide = textkit.words(pa.array(["é z", None, "last one"], pa.large_string()))
    assert np.array_equal(a.hashes, wide.hashes)
