"""A store of page records in buckets, read by the links that are wanted.

A store is a bucketed, sorted parquet table below a path, with Bloom filters of the keys
in its files. A few wanted keys go to the scan as a list: it opens their buckets
only, and in these the row groups that may hold them. Many wanted keys are joined
bucket by bucket: they are shuffled, the pages are not.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgrisk import files
from msgrisk.operators.pages import RECORD, resolve_sources

FEW = 1000  # wanted keys that are listed in the plan
COLUMNS = ["key", *RECORD, "version"]


def _manifest(path: str) -> str:
    return f"{path}/_store.json"


def _table(spark: SparkSession, path: str) -> str:
    """The store's name in the session's catalog; an external table, made if needed."""
    name = f"page_store_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        buckets = json.loads(files.read_text(spark, _manifest(path)))["buckets"]
        kinds = ", ".join(f"`{c}` {'bigint' if c == 'version' else 'string'}" for c in COLUMNS)
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({kinds}) USING parquet CLUSTERED BY (`key`) SORTED BY (`key`) "
            f"INTO {int(buckets)} BUCKETS LOCATION '{location}'"
        )
    return name


def add_pages(records: DataFrame, path: str, buckets: int | None = None) -> int:
    """Add page records (``operators.pages.page_records``) to a store; returns the version.

    Each call is a version. Of records that share a key the first success in the order
    of ``resolve_sources`` is kept; null keys are left out. The number of buckets, by
    default that of shuffle partitions, is settled by the first call.
    """
    spark = records.sparkSession
    text = files.read_text(spark, _manifest(path))
    if text:
        facts = json.loads(text)
    else:
        count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        facts = {"buckets": count, "next": 0, "open": []}
    version = facts["next"]
    facts = facts | {"next": version + 1, "open": [*facts["open"], version]}
    files.write_text(spark, _manifest(path), json.dumps(facts))
    best = resolve_sources([records.filter(F.col("key").isNotNull())])
    rows = best.select("key", *[f"page.{c}" for c in RECORD], F.lit(version).cast("long").alias("version"))
    writer = rows.repartition(facts["buckets"], "key").write.format("parquet").mode("append")
    writer = writer.bucketBy(facts["buckets"], "key").sortBy("key")
    writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("path", path)
    writer.saveAsTable(_table(spark, path))
    # Rows of a version count once it is not open any more; those of a cut-off call never do.
    facts["open"].remove(version)
    files.write_text(spark, _manifest(path), json.dumps(facts))
    return version


def every_page(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the finished versions of a store."""
    facts = json.loads(files.read_text(spark, _manifest(path)))
    finished = (F.col("version") < facts["next"]) & ~F.col("version").isin(facts["open"])
    return spark.table(_table(spark, path)).filter(finished)


def wanted_pages(keys: DataFrame, path: str, few: int = FEW) -> DataFrame:
    """``(key, page)`` for the wanted keys that the store has, as ``link_pages`` takes them.

    ``keys`` has one column, ``key``; repeats and nulls do not matter. The newest success
    of a key counts, or else its newest failure. Wanted keys are combined where they are
    read. Up to ``few`` of them are collected for the plan, more are joined; neither
    shuffles the pages.
    """
    spark = keys.sparkSession
    rows = every_page(spark, path)
    distinct = keys.select("key").filter(F.col("key").isNotNull()).distinct()
    listed = [r["key"] for r in distinct.limit(few + 1).collect()]
    if len(listed) <= few:
        found = rows.filter(F.col("key").isin(listed))
    else:
        found = rows.join(distinct.hint("shuffle_hash"), "key", "left_semi")
    newest = Window.partitionBy("key").orderBy((F.col("status") != "success"), F.col("version").desc())
    first = found.withColumn("_turn", F.row_number().over(newest)).filter("_turn = 1")
    return first.select("key", F.struct(*RECORD).alias("page"))
