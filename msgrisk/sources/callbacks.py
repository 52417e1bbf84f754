"""Chat callbacks from files, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from msgrisk import schemas
from msgrisk.operators import callbacks


def read_callbacks(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines with the parameters and the body as text."""
    return callbacks.parse(spark.read.schema(schemas.ENVELOPE).json(path))


def stream_callbacks(
    spark: SparkSession, path: str, bytes_per_batch: int = 1 << 30, more: str = ""
) -> DataFrame:
    """The same as a stream. The limit of bytes bounds the size of a micro-batch.

    ``more`` declares fields that lie beside the request, such as a verdict.
    """
    schema = ", ".join(filter(None, (schemas.ENVELOPE, more)))
    raw = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).json(path)
    return callbacks.parse(raw)
