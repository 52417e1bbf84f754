"""Human label sheets, one folder or file per sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.operators.labels import require_columns
from msgrisk.sources import datasets, records


def read_sheets(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Label sheets below ``path/sheet=<name>/``: ``sheet, position, content, rating``.

    CSV sheets are one file each, of any size, and take their position from the order in it.
    Parquet sheets must bring a ``position`` column, since large ones are split.
    """
    if kind == "csv":
        files = spark.read.option("basePath", path).text(path).inputFiles()
        if len({f.rsplit("/", 1)[0] for f in files}) < len(files):
            raise ValueError("a CSV sheet must be one file, as files have no order")
        name = F.url_decode(F.regexp_replace(F.regexp_extract("file", "/sheet=([^/]*)/", 1), "\\+", "%2B"))
        df = records.read_table(spark, [path], {"sheet": name})
        df = require_columns(df, ["content", "rating", "sheet"], "label sheets")
        df = df.withColumn("rating", datasets.number_or_null(F.col("rating")))
    else:
        df = spark.read.option("basePath", path).format(kind).load(path)
        df = require_columns(df, ["content", "rating", "sheet", "position"], "label sheets")
    return df.select(F.col("sheet").cast("string").alias("sheet"), "position", "content", "rating")
