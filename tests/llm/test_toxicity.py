import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadtide.llm import queries, toxicity
from tests.conftest import SF_DIR


def plain_ftrl(examples, labels, size, epochs):
    """The published per-coordinate rule, one coordinate at a time."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i, l1, l2):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

    for _ in range(epochs):
        for slots, y in zip(examples, labels):
            w = {i: weight(i, toxicity.L1, toxicity.L2) for i in slots} | {size: weight(size, 0, 0)}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
            for i in w:
                sigma = (math.sqrt(n[i] + (p - y) ** 2) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += p - y - sigma * w[i]
                n[i] += (p - y) ** 2
    return [weight(i, toxicity.L1, toxicity.L2) for i in range(size)], weight(size, 0, 0)


def test_learning_matches_the_rule_by_coordinate(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rng = random.Random(1)
    examples = [sorted(rng.sample(range(32), 6)) for _ in range(60)]
    labels = [int(3 in e or 7 in e) for e in examples]
    got, bias = toxicity.ftrl([np.array(e) for e in examples], np.array(labels, float), bits=5, epochs=3)
    want, want_bias = plain_ftrl(examples, labels, 32, 3)
    assert np.allclose(got, want, atol=1e-9) and bias == pytest.approx(want_bias, abs=1e-9)
    assert 0 < np.count_nonzero(got) < 32


def test_features_are_words_stems_and_pairs():
    slots, first = toxicity.distinct_features(pa.array(["a b c", "B, a! C a", "", None, "a a a a"]))
    sets = [set(slots[x:y]) for x, y in zip(first[:-1], first[1:])]
    assert len(sets[0]) == 3 + 2 + 1 and not sets[2] and not sets[3] and len(sets[4]) == 3
    words = toxicity.distinct_features(pa.array(["a", "b", "c"]))[0]
    assert set(words) <= sets[0] & sets[1]
    stems = [set(toxicity.distinct_features(pa.array([w]))[0]) for w in ("worthless", "worthlessly")]
    assert len(stems[0] & stems[1]) == 2


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = queries.QUERIES["op7_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out")
    row = found.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught"),
                    F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert row.right > 0.97 and row.caught > 0.85 and row.false < 0.02


def test_query_columns(spark):
    got = queries.QUERIES["op7_toxicity"](spark, SF_DIR)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_odd_rows(spark):
    rows = [(i, "bad word here" if i % 3 == 0 else "fine words there") for i in range(60)] + [(60, None), (61, ""), (None, "bad word here"), (62, "bad " * 50_000), (3, "bad word here")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(60)] + [(None, 1, 1), (5, None, 1), (7, 0, 0), (7, 0, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train_labelled(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r, (_, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        by_text.setdefault(t or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())  # equal texts have equal scores, null is empty
    assert min(by_text["bad word here"]) > 0.5 > max(by_text["fine words there"])
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    untrained = toxicity.train_labelled(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, untrained).collect()} == {0.5}


def test_sample_is_bounded(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    usable = labels.withColumn("place", F.xxhash64("doc_id"))
    assert 350 < toxicity._sampled(usable, 500).count() < 650
    assert toxicity.train_labelled(docs, labels, F.lit(True), rows=500).bias is not None
