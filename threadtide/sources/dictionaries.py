"""Keyword dictionaries from JSON files."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

log = logging.getLogger(__name__)

DICTIONARY = T.StructType([T.StructField("category", T.StringType()), T.StructField("keyword", T.StringType())])
# A dictionary that becomes plan literals must stay this small.
MAX_ENTRIES = 20_000


def load_dictionary(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """(category, keyword) rows of a JSON object of string lists; repeats removed.

    ``group`` picks a nested object of lists. A missing file or broken JSON gives no rows and a
    warning.
    """
    try:
        raw = spark.read.text(path, wholetext=True)
        value = F.col("value") if group is None else F.get_json_object("value", f"$.{group}")
        lists = raw.select(F.from_json(value, "map<string,string>").alias("m")).select(
            F.explode("m").alias("category", "items")
        )
        entries = lists.select("category", F.explode(F.from_json("items", "array<string>")).alias("keyword"))
        out = entries.where(F.col("keyword").isNotNull()).dropDuplicates(["category", "keyword"])
        empty = out.isEmpty()
    except AnalysisException as problem:
        log.warning("dictionary %s not read: %s", path, problem.getCondition())
        return spark.createDataFrame([], DICTIONARY)
    if empty:
        log.warning("dictionary %s has no entries", path)
    return out


def keyword_lists(dictionary: DataFrame) -> dict[str, list[str]]:
    """category -> sorted entries, after checking the dictionary's size."""
    rows = dictionary.select("category", "keyword").limit(MAX_ENTRIES + 1).toArrow().to_pylist()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries: use keyword_rows with the table instead")
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["category"], r["keyword"])):
        out.setdefault(row["category"], []).append(row["keyword"])
    return out
