"""What came before each row of a table in one global order, as a scan.

The order is dealt over ranges, one per task. Each range is summed up by one value, the
last one that matters, and what holds where a range begins follows from the sums of
the ranges before it. Rows are sorted once, written once and read once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from msgrisk.session import scratch_path


def last_before(
    df: DataFrame, order: str, value: Column, where: Column, name: str,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``name``: the value of the last row before this one for which ``where`` holds.

    ``order`` must not have ties; nulls come first. The value may be null; without any
    such row before, it is null too. With ``rows_per_task`` the rows are counted and a
    task sorts about that many, else Spark decides on the number of ranges. Driver and
    broadcast hold one value per range.
    """
    marked = df.withColumns({"_value": value, "_counts": F.coalesce(where, F.lit(False))})
    if rows_per_task is None:
        dealt = marked.repartitionByRange(order)
    elif rows_per_task < 1:
        raise ValueError("rows_per_task must be at least 1")
    else:
        count = max(1, math.ceil(marked.count() / rows_per_task))
        dealt = marked.repartitionByRange(count, order)
    kind = marked.schema["_value"].dataType
    schema = StructType([
        *marked.schema.fields, StructField("_piece", IntegerType()), StructField("_own", kind),
        StructField("_known", BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, target = TaskContext.get().partitionId(), to_arrow_schema(schema)
        last, known = None, False
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n, counts = batch.num_rows, column["_counts"].to_numpy(zero_copy_only=False)
            if last is None:
                last = pa.nulls(1, column["_value"].type)
            values = pa.concat_arrays([last, column["_value"]])  # the value held, then the batch's
            newest = np.maximum.accumulate(np.append(0, np.where(counts, np.arange(1, n + 1), 0)))
            own = values.take(pa.array(newest[:-1]))
            has = known | (newest[:-1] > 0)
            last, known = values.slice(int(newest[-1]), 1), bool(known or newest[-1] > 0)
            found = [*batch.columns, pa.array(np.full(n, piece, np.int32)), own, pa.array(has)]
            yield pa.RecordBatch.from_arrays(
                [a.cast(target.field(i).type) for i, a in enumerate(found)], schema=target
            )

    path = scratch_path(df.sparkSession, "scan")
    dealt.sortWithinPartitions(order).mapInArrow(run, schema).write.parquet(path)
    rows = df.sparkSession.read.schema(schema).parquet(path)
    newest = F.max_by(F.struct("_value"), F.when(F.col("_counts"), F.struct(F.col(order).isNotNull(), order)))
    pieces = rows.groupBy("_piece").agg(newest.alias("_last"))
    so_far = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = pieces.select("_piece", F.last("_last", ignorenulls=True).over(so_far).alias("_head"))
    joined = rows.join(F.broadcast(heads), "_piece")
    found = F.when(F.col("_known"), F.col("_own")).otherwise(F.col("_head")["_value"])
    return joined.select(*df.columns, found.alias(name))
