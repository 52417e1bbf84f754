"""Counts that batches add to give the metrics of all rows."""

import random

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from msgrisk.operators import metrics
from msgrisk.streaming import counters

ROW = "sheet string, `human rating` double, rating double"
BY = StructType([StructField("sheet", StringType())])


def rated(seed, n):
    rng = random.Random(seed)
    number = lambda: rng.choice([None, 0.4, 5.5, *[x / 2 for x in range(2, 11)]])
    return [(rng.choice(["a", "b", "", None]), number(), number()) for _ in range(n)]


def record(df, by):
    rows = metrics.summary(df, by).collect() + metrics.confusion(df, by).collect()
    rounded = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(map(repr, rounded))


@pytest.mark.parametrize("by", [[], ["sheet"]])
def test_counts_equal_a_full_scan_after_each_batch(spark, tmp_path, by):
    kinds, path, seen = BY if by else None, str(tmp_path / "c"), []
    for number in range(5):
        some = rated(number, 0 if number == 2 else 80)
        batch = metrics.clean(spark.createDataFrame(some, ROW))
        kept = counters.Counters(spark, path, kinds)
        kept.add(number, batch)
        if number in (1, 4):
            kept.add(number, batch)  # run again
        seen += some
        full = metrics.clean(spark.createDataFrame(seen, ROW))
        assert record(counters.counters_of(spark, path, kinds), by) == record(full, by)


def test_a_stream_of_files(spark, tmp_path):
    source, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for lot in range(2):
        rows = rated(lot, 50)
        seen += rows
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
        assert counters.evaluate_stream(stream, out, out + "-p", ["sheet"]).awaitTermination(60)
        full = metrics.clean(spark.createDataFrame(seen, ROW))
        assert record(counters.counters_of(spark, out, BY), ["sheet"]) == record(full, ["sheet"])
