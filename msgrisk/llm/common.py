"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from msgrisk import files
from msgrisk.session import scratch_path


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    This cuts the lineage: what follows never repeats the work above, and the
    rows outlive every executor. All partitions are written to the folder that
    ``spark.checkpoint.dir`` names.
    """
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


class Rounds:
    """Tables that replace each other, round by round; the one before is deleted."""

    def __init__(self, label: str):
        self.label, self.path = label, None

    def stored(self, frame: DataFrame) -> DataFrame:
        """Write a round's table. Nothing may read the round before it any more."""
        spark, path = frame.sparkSession, scratch_path(frame.sparkSession, self.label)
        frame.write.parquet(path)
        if self.path is not None:
            files.remove(spark, self.path)
        self.path = path
        return spark.read.schema(frame.schema).parquet(path)


def map_rows(
    frame: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]],
    schema: StructType,
    rows_per_batch: int = 2000,
) -> DataFrame:
    """``mapInArrow`` with a function that gives column lists for a batch.

    ``make`` runs once in each task and returns the function, so that models are
    loaded once. Each dict holds one list for each column of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_batch):
                for columns in work(batch.slice(start, rows_per_batch)):
                    arrays = [pa.array(columns[n], target.field(n).type) for n in names]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return frame.mapInArrow(run, schema)


def row_key(*columns: Column) -> Column:
    """One value, never null, that tells rows apart by some of their columns."""
    parts = [F.md5(F.coalesce(c.cast("string"), F.lit("null"))) for c in columns]
    nulls = [c.isNull().cast("string") for c in columns]
    return F.unhex(F.md5(F.concat(*parts, *nulls)))


def of_key(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept`` (one column), one for each key.

    Copies are combined where they are read; texts are moved once.
    """
    name = "__key_of_row"
    keyed = docs.withColumn(name, key).dropDuplicates([name])
    return keyed.join(kept.toDF(name), name, "left_semi").select(*docs.columns)


def in_ranges(frame: DataFrame, order: list[str], label: str) -> DataFrame:
    """The rows sorted over ranges and written, with ``part`` and ``at``.

    ``part`` is the number of a row's range and ``at`` its place in it. Ranges follow
    each other in the order of the columns; rows of one key may lie in several, so
    ``order`` should end with a column that tells rows apart.
    """
    names = frame.schema.names
    schema = StructType([
        StructField("part", LongType()), StructField("at", LongType()), *frame.schema.fields
    ])

    def make():
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), [0]

        def work(batch):
            at = range(seen[0], seen[0] + batch.num_rows)
            seen[0] = at.stop
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            yield columns | {"part": [part] * batch.num_rows, "at": at}

        return work

    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(map_rows(dealt, make, schema, 10_000), label)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def shrunk(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 compressed, lowest bytes first."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def grown(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)
