import math
import random

from pyspark.sql import functions as F

from threadtide.llm import licenses

ROWS = [
    (1, "/a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software, to deal in the Software without restriction."),
    (2, "/a/b/c/x.py", "some code\nmore code here"),
    (3, "/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode " + "word " * 60),
    (4, "/a/b/d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
    (5, "/a/b/d/e/z.py", "plain"),
    (6, "/q/z.py", "plain license words of version"),
    (7, "/a/b/d/own.py", "released under the MIT license"),
    (8, None, "All rights reserved."),
    (None, "/a/n.py", None),
    (9, "/a/b/c/empty.py", ""),
    (10, "/r/long.py", "word " * 50_000 + "\nLICENSED UNDER CC BY-NC 4.0.\n" + "\n" * 1000),
    (11, "top.py", "plain"),
]


def scan(spark, rows, schema="id long, path string, text string, own string, line int"):
    frame = spark.createDataFrame([(*r, "o", 1) for r in rows], schema)
    return {(r.id, r.path): r for r in licenses.scan(frame, "id", F.col("path")).collect()}


def test_own_and_inherited(spark):
    got = {k[0]: (r.license, r.origin, r.inherited_from) for k, r in scan(spark, ROWS * 2).items()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "/a"), 3: ("Apache-2.0", "own", None), 4: ("GPL-3.0", "own", None),
        5: ("GPL-3.0", "inherited", "/a/b/d"), 6: (None, "none", None), 7: ("MIT", "own", None), 8: ("all-rights-reserved", "own", None),
        None: (None, "none", None), 9: ("MIT", "inherited", "/a"), 10: ("CC-BY-NC-4.0", "own", None), 11: (None, "none", None),
    }


def test_empty_table(spark):
    assert scan(spark, []) == {}


def test_anchors_lose_no_match(spark):
    rng = random.Random(1)
    pool = [t for _, n in licenses.TEMPLATES for t in licenses.terms_of(n)] + ["foo", "bar"]
    rows = []
    for i in range(300):
        words = licenses.terms_of(rng.choice(licenses.TEMPLATES)[1])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(pool)
        rows.append((i, f"/{i}/x", " ".join(words)))
    got = {r.id: (r.license, r.score) for r in licenses.matches(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    sets = [set(t.split()) for _, _, t in rows]
    idf = lambda term: licenses.idf(len(rows), sum(term in s for s in sets) if any(term in licenses.terms_of(n) for _, n in licenses.TEMPLATES) else 0)
    vectors = licenses.weights(licenses.TEMPLATES, {t: idf(t) for _, n in licenses.TEMPLATES for t in licenses.terms_of(n)})
    for i, _, text in rows:
        words = text.split()
        mine = {t: words.count(t) * idf(t) for t in set(words)}
        norm = math.sqrt(sum(w * w for w in mine.values()))
        best = max((round(sum(mine.get(t, 0) * w for t, w in v.items()) / norm, 6), name) for (name, _), v in zip(licenses.TEMPLATES, vectors))
        if best[0] >= licenses.THRESHOLD + 1e-5:
            assert abs(got[i][1] - best[0]) < 2e-6
        elif best[0] < licenses.THRESHOLD - 1e-5:
            assert i not in got


def test_plan_is_native(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.scan(frame, "doc_id", licenses.document_path())._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
