"""Lineage cuts in the session's shared folder, and the sizes that partitions follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadtide.session import ensure_checkpoint_dir, scratch_path


def cut(frame: DataFrame) -> DataFrame:
    """The frame computed once and kept in spark.checkpoint.dir, so that a lost executor costs no more than a reread."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir."""
    return scratch_path(spark, name)


def keep(frame: DataFrame, **options: str) -> DataFrame:
    """The frame written as Parquet under spark.checkpoint.dir and read again: columnar, compressed, with sizes that plans use."""
    spark = frame.sparkSession
    path = scratch_path(spark, "kept")
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
