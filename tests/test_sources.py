import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadtide.schema import PROCESSED, RAW
from threadtide.sources import dictionaries, reports, tables
from threadtide.sources.events import EventWindow, event_dimension


def raw_rows(spark):
    stamp = datetime(2024, 1, 1, 10, 0, 0, 123456)
    row = ("p1", "title", "u", "[deleted]", stamp, 5, 2, 0.9, True, "", None, "/p", "c1", "body\n“x”", "bob", stamp, -3, "/c")
    return spark.createDataFrame([row, (*row[:12], "c2", "b", "[deleted]", None, 1, "/d")], RAW).withColumn("event_name", F.lit("E1"))


def test_raw_round_trip(spark, tmp_path):
    df = raw_rows(spark)
    assert tables.write_raw(df, str(tmp_path / "raw"))
    back = tables.read_raw(spark, str(tmp_path / "raw"), df.schema)
    assert back.where("source_file like '%.json'").count() == 2
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert not tables.write_raw(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_indented_array_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"post_id": "p", "comment_id": "c", "comment_score": 3, "post_created_utc": "2024-01-01T00:00:00"}], indent=4))
    row = tables.read_raw(spark, str(tmp_path / "a.json"), multiline=True).first()
    assert (row["post_id"], row["comment_score"], row["post_created_utc"], row["selftext"]) == ("p", 3, datetime(2024, 1, 1), None)


def test_processed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not tables.has_rows(spark, path)
    empty = tables.read_processed(spark, path)
    assert empty.schema == PROCESSED and empty.isEmpty()
    df = spark.createDataFrame([(1, True, datetime(2024, 1, 1))], "i int, b boolean, t timestamp")
    tables.write_processed(df, path)
    tables.write_processed(df, path)
    back = tables.read_processed(spark, path, df.schema)
    assert back.collect() == df.collect() and tables.has_rows(spark, path)
    with pytest.raises(ValueError):
        tables.write_processed(back, path)
    assert back.count() == 1


def test_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    halfway = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        tables.write_processed(halfway, path)  # no table before: none after
    assert not tables.has_rows(spark, path) and tables.read_processed(spark, path, halfway.schema).isEmpty()
    tables.write_processed(spark.range(3), path)
    with pytest.raises(Exception, match="stop"):
        tables.write_processed(halfway, path)
    assert sorted(r["id"] for r in tables.read_processed(spark, path, halfway.schema).collect()) == [0, 1, 2]
    assert len(list((tmp_path / "t").iterdir())) == 1


def test_replaced_table_while_it_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_processed(spark.range(3), path)
    old = tables.read_processed(spark, path, None)
    (tmp_path / "t" / "version-9999999999-abc").mkdir()  # a writer that was lost, or still writes
    assert tables.read_processed(spark, path, None).count() == 3
    tables.write_processed(spark.range(5), path)
    assert old.count() == 3 and tables.read_processed(spark, path, None).count() == 5
    tables.write_processed(spark.range(7), path)
    tables.write_processed(spark.range(8), path)
    assert tables.read_processed(spark, path, None).count() == 8
    assert len([p for p in (tmp_path / "t").iterdir() if (p / "_WHOLE").exists()]) == 2


def test_second_builder(spark, tmp_path):
    path = str(tmp_path / "t")

    def build():
        tables.load_or_build(spark, path, lambda: spark.range(4))  # another job is done first
        return spark.range(6)

    assert tables.load_or_build(spark, path, build).count() == 6
    assert tables.load_or_build(spark, path, build).count() == 6


def test_load_or_build(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return spark.range(3)

    # an existing table without rows is built as well
    tables.write_processed(spark.range(0), path)
    assert tables.load_or_build(spark, path, build).count() == 3
    assert tables.load_or_build(spark, path, build).count() == 3
    assert built == [1]


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"teams": ["Og", "x.y", "Og", None], "empty": [], "types": {"move": ["a"], "win": ["b", "c"]}}, indent=2))
    flat = dictionaries.keyword_lists(dictionaries.load_dictionary(spark, str(path)))
    assert flat == {"teams": ["Og", "x.y"]}
    assert dictionaries.keyword_lists(dictionaries.load_dictionary(spark, str(path), "types")) == {"move": ["a"], "win": ["b", "c"]}
    assert dictionaries.load_dictionary(spark, str(tmp_path / "absent.json")).isEmpty()
    path.write_text("{broken")
    assert dictionaries.load_dictionary(spark, str(path)).isEmpty()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "event_name string, mean double")
    reports.write_report(df, str(tmp_path / "r"), "Means")
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().asDict() == {"title": "Means", "event_name": "a", "mean": "1.5"}
    text = reports.as_text(df, "Means")
    assert text.startswith("Means\n=====\n") and "event_name" in text
    with pytest.raises(ValueError):
        reports.as_text(spark.range(5), max_rows=4)


def test_event_dimension(spark):
    row = event_dimension(spark, [EventWindow("E", datetime(2024, 3, 1), datetime(2024, 3, 2), "q")], 2, 1).first()
    assert (row["pre_start_ts"], row["post_end_ts"], row["query"]) == (datetime(2024, 2, 28), datetime(2024, 3, 3), "q")
