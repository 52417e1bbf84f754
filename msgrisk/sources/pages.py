"""Stores of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.functions import urls, verdicts
from msgrisk.operators import pages


def read_pages(spark: SparkSession, path: str, method: str = "store") -> DataFrame:
    """Page records of a parquet table with ``url`` and ``html``."""
    return pages.page_records(spark.read.parquet(path), method)


def records_from_replies(replies: DataFrame, url: str = "url", reply: str = "reply") -> DataFrame:
    """Page records from the raw replies of a fetch tool, JSON or plain text."""
    record = verdicts.page_or_text(F.col(reply), F.col(url))
    rows = replies.select(F.col(url).alias("_url"), record.alias("r"))
    return rows.select(
        urls.url_key(F.col("_url")).alias("key"),
        F.col("_url").alias("url"),
        *[f"r.{c}" for c in pages.RECORD if c != "url"],
    )
