"""Evaluation that is kept up to date: counts of rating pairs as rows arrive.

All metrics follow from the counts of 25 pairs per group (``operators.metrics``). A batch
adds its counts to those of its groups, once, also if it is run again; the rows
themselves are not read any more.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from msgrisk.operators import metrics
from msgrisk.streaming.state import KeyedState

PAIR = ["human_rating_int", "rating_int"]


class Counters:
    """Counts of (human, predicted) pairs per group, below ``path``.

    ``by`` are the grouping columns with their types. Groups without a value in one of
    them count too: nulls are kept as a group of their own.
    """

    def __init__(self, spark: SparkSession, path: str, by: StructType | None = None, buckets: int = 16):
        fields = list(by.fields) if by else []
        self.by = [f.name for f in fields]
        # A state's keys have no nulls, so each grouping column stands beside a flag.
        keys = [part for f in fields for part in (StructField(f.name, f.dataType), _flag(f.name))]
        keys += [StructField(n, IntegerType()) for n in PAIR]
        values = StructType([StructField("n", LongType())])
        self.defaults = {f.name: f.dataType for f in fields}
        self.state = KeyedState(spark, path, StructType(keys), values, None, timedelta(0), buckets)

    def add(self, number: int, clean: DataFrame) -> None:
        """Add the rows of ``metrics.clean`` that are batch ``number``."""
        new = metrics.cells(clean, self.by).toDF(*self.by, *PAIR, "n")
        for name, kind in self.defaults.items():
            null = F.col(name).isNull()
            filler = F.lit("").cast(kind) if kind.typeName() == "string" else F.lit(0).cast(kind)
            new = new.withColumns({_flag(name).name: null, name: F.coalesce(name, filler)})
        old = self.state.before(number, new)
        both = new.unionByName(old).groupBy(*self.state.keys).agg(F.sum("n").alias("n"))
        self.state.commit(number, both)

    def read(self, before: int | None = None) -> DataFrame:
        """The counts so far, or as they were before a batch, as rows that the metrics take."""
        rows = self.state.every(before)
        for name in self.by:
            rows = rows.withColumn(name, F.when(~F.col(_flag(name).name), F.col(name)))
        return rows.select(*self.by, *PAIR, F.col("n").alias(metrics.COUNTED))


def _flag(name: str) -> StructField:
    return StructField(f"_no_{name}", BooleanType())


def evaluate_stream(
    rows: DataFrame, path: str, checkpoint: str, by: list[str] = (), human: str = "human rating",
    pred: str = "rating", once: bool = True, seconds: int = 10,
) -> StreamingQuery:
    """Count the rating pairs of a stream; ``counters_of`` reads them at any time."""
    kinds = StructType([rows.schema[n] for n in by])

    def run(batch: DataFrame, number: int) -> None:
        Counters(batch.sparkSession, path, kinds).add(number, metrics.clean(batch, human, pred))

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def counters_of(spark: SparkSession, path: str, by: StructType | None = None) -> DataFrame:
    """What ``evaluate_stream`` has counted, for any function of ``operators.metrics``."""
    return Counters(spark, path, by).read()
