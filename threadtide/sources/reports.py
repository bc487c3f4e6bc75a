"""Report tables and model metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from threadtide.operators.bounded import materialize_small


def write_report(df: DataFrame, path: str, title: str | None = None, fmt: str = "csv") -> None:
    """Write a report table with its key columns; a title becomes a column."""
    out = df if title is None else df.select(F.lit(title).alias("title"), "*")
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def as_text(df: DataFrame, title: str | None = None, max_rows: int = 1000) -> str:
    """Fixed-width text of a small report table, under its title."""
    local, small = materialize_small(df, max_rows)
    if not small:
        raise ValueError(f"more than {max_rows} rows: write the table instead")
    body = local.toPandas().to_string(index=False)
    return body if title is None else f"{title}\n{'=' * len(title)}\n\n{body}"


def metrics_table(spark: SparkSession, metrics: Mapping[str, Mapping[str, float]], params: Mapping[str, str] | None = None) -> DataFrame:
    """(run_ts, model, metric, value, params) rows of a training run."""
    rows = [(model, metric, float(value)) for model, part in metrics.items() for metric, value in part.items()]
    table = spark.createDataFrame(rows, "model string, metric string, value double")
    entries = [F.lit(str(x)) for pair in (params or {}).items() for x in pair]
    kept = F.create_map(*entries).cast("map<string,string>") if entries else F.lit(None).cast("map<string,string>")
    return table.select(F.current_timestamp().alias("run_ts"), "*", kept.alias("params"))


def append_metrics(table: DataFrame, path: str) -> None:
    table.write.mode("append").parquet(path)
