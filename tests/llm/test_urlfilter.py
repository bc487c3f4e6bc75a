import numpy as np
from pyspark.sql import functions as F

from threadtide.llm import urlfilter

URLS = [
    ("http://Example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.EXAMPLE.com/en/x?u=/fr/#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("https://a.b.example.com/en/", "a.b.example.com", "/en/", "example.com/en/", "block"),
    ("https://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    ("https://example.com", "example.com", "", None, "allow"),
    ("https://example.com?q=/en/", "example.com", "", None, "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/ES/1", "x.net", "/ES/1", None, "allow"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("ftp://spam-farm.example.org/a://b", "spam-farm.example.org", "/a://b", None, "block"),
    ("http://spam-farm.example.com/de/", "spam-farm.example.com", "/de/", "com/", "allow"),
    ("http://notspam-farm.org/", "notspam-farm.org", "/", None, "allow"),
    ("example.com/en/", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://" + "a." * 2000 + "com/" + "x" * 50_000, "a." * 2000 + "com", "/" + "x" * 50_000, "com/", "allow"),
]


def test_urls(spark):
    frame = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS * 2)], "page_id int, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(frame).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS * 2)}


def test_empty_tables_null_keys_and_no_list(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(none).count() == 0
    frame = spark.createDataFrame([(None, "http://a.org/")], "page_id long, url string")
    assert [tuple(r) for r in urlfilter.judge(frame, rules=(("x", "/", "block"),), blocked_labels=("y",)).collect()] == [(None, "a.org", "/", None, "allow")]


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(
        F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).bitwiseOR(F.lit(1)).alias("h2"), (F.col("id") % 37 == 0).alias("listed")
    ).cache()
    levels = urlfilter.cascade(universe)
    assert len(levels) > 1
    rows = universe.toPandas()
    found = urlfilter.listed(levels, *(rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")))
    assert np.array_equal(found, rows["listed"].to_numpy())
    assert sum(level.bits for level in levels) < 16 * rows["listed"].sum()
