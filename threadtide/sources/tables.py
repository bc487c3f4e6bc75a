"""Raw landings and processed tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from threadtide.schema import PROCESSED, RAW

#: Beginning of the name of a version's folder, and the mark inside a whole one.
VERSION, WHOLE = "version-", "_WHOLE"


def write_raw(df: DataFrame, path: str, partition: str = "event_name") -> bool:
    """Land collected rows as JSON, one folder per event, timestamps as ISO text; skipped when empty."""
    if df.isEmpty():
        return False
    writer = df.write.mode("overwrite").partitionBy(partition)
    writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX").json(path)
    return True


def read_raw(spark: SparkSession, path: str, schema: T.StructType = RAW, multiline: bool = False) -> DataFrame:
    """Landed rows with their file name. multiline reads files that hold one indented array each."""
    reader = spark.read.schema(schema).option("multiLine", multiline)
    return reader.json(path).withColumn("source_file", F.col("_metadata.file_name"))


def write_processed(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace the processed table as a whole; a failed write leaves the old rows as they are.

    Every write has a version folder of its own, and an empty mark inside it, made last, is what readers look
    for: they see the old or the new table, never neither and never both. Of two writers at once the later
    version is read. The version before stays for plans that still read it; older ones, and an unmarked folder of a
    failed write, are deleted. A path that df itself reads is refused, since later writes would delete its files. The
    folder is read through `read_processed`; files of a table written without versions stay beside them, unread.
    """
    spark = df.sparkSession
    target = _qualified(spark, path)
    if any(_one_slash(f).startswith(target + "/") for f in df.inputFiles()):
        raise ValueError(f"{path} is read by the plan that would replace it")
    before = _versions(spark, path)
    number = 1 + max((int(v.split("-")[1]) for v in before), default=0)
    version = f"{path.rstrip('/')}/{VERSION}{number:010d}-{uuid.uuid4().hex}"
    try:
        (df.write.partitionBy(partition) if partition else df.write).parquet(version)
    except BaseException:
        _delete(spark, version)
        raise
    fs, mark = _located(spark, f"{version}/{WHOLE}")
    fs.createNewFile(mark)
    for old in _versions(spark, path, marked=True)[:-2]:
        _delete(spark, f"{path.rstrip('/')}/{old}")


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str, marked: bool = False) -> list[str]:
    """Names of the version folders, the latest last; on request only whole ones."""
    fs, where = _located(spark, path)
    if not fs.exists(where):
        return []
    names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(where)) if n.startswith(VERSION))
    return [n for n in names if fs.exists(_located(spark, f"{path.rstrip('/')}/{n}/{WHOLE}")[1])] if marked else names


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _located(spark, path)
    fs.delete(where, True)


def _current(spark: SparkSession, path: str) -> str:
    """The folder of the latest whole version, or the path itself where the table has no versions."""
    whole = _versions(spark, path, marked=True)
    return f"{path.rstrip('/')}/{whole[-1]}" if whole else path


def _unfinished(spark: SparkSession, path: str) -> bool:
    """Nothing but versions that are not whole: a first write is running or has failed."""
    fs, where = _located(spark, path)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return False
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return all(n.startswith((VERSION, "_", ".")) for n in names) and any(n.startswith(VERSION) for n in names)


def _one_slash(path: str) -> str:
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def _qualified(spark: SparkSession, path: str) -> str:
    fs, where = _located(spark, path)
    return _one_slash(fs.makeQualified(where).toString())


def read_processed(spark: SparkSession, path: str, schema: T.StructType | None = PROCESSED) -> DataFrame:
    """All rows of the processed table's latest whole version; no rows where it is missing or never was whole."""
    path = _current(spark, path)
    if _unfinished(spark, path):
        return spark.createDataFrame([], schema or T.StructType())
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema or T.StructType())


def has_rows(spark: SparkSession, path: str) -> bool:
    """The table exists and holds at least one row; reads one row at most."""
    path = _current(spark, path)
    if _unfinished(spark, path):
        return False
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], schema: T.StructType | None = None) -> DataFrame:
    """The stored table if it has rows, else build, store and read it."""
    if not has_rows(spark, path):
        write_processed(build(), path)
    return read_processed(spark, path, schema)


def spread(df: DataFrame) -> DataFrame:
    """Even out a scan of fewer partitions than cores ahead of heavy per-row text work.

    Scans with enough partitions (any large table) are left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
