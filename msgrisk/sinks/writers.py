"""Tables and files the library writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.operators import metrics

_CSV = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def write_scored(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scored datasets, one folder per ``dataset`` and ``model``."""
    df.write.mode(mode).options(**_CSV).partitionBy("dataset", "model").csv(path)


def write_merged_labels(df: DataFrame, path: str) -> None:
    """Merged labels ``content, human rating, rating`` in sheet and row order."""
    ordered = df.orderBy("sheet", "row") if {"sheet", "row"} <= set(df.columns) else df
    ordered.select("content", "human rating", "rating").write.mode("overwrite").options(
        **_CSV
    ).csv(path)


def write_metrics(clean: DataFrame, path: str, by: list[str] = ()) -> None:
    """One JSON object of all metrics per group."""
    rows = metrics.metrics_json(clean, by)
    rows.select(F.col("metrics").alias("value")).write.mode("overwrite").text(path)


def write_workflow_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_alerts(df: DataFrame, path: str) -> None:
    """Append alert payloads to a table, for a delivery service to pick up."""
    df.write.mode("append").parquet(path)
