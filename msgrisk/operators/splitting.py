"""Ordered per-key work on keys that are too large for one task.

A window ``partitionBy(key).orderBy(order)`` puts all rows of a key into one
task. Rows of keys that are too large for that are sorted by key and order over
ranges of a number of rows, whatever the size of the table, and written below the
shared folder. Each range is a piece, the window runs per key and piece, and what a
piece needs from the pieces before it comes in afterwards: a few rows
(``with_carry``) or an offset (``numbered``). Results equal those of the plain
window.

A caller who gives a number of rows per task has all rows cut into such ranges. Without
it, a table that Spark takes for larger than ``TABLE_BYTES`` is looked through for large
keys by a sketch, and only their rows are cut; of a smaller table no key can be too
large, so the plain window is planned and no job runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.session import scratch_path


TABLE_BYTES = 256 << 20  # by Spark's estimate; smaller tables are not looked through
ROWS = 1_000_000  # of a key, from which on it is cut, and of its pieces
TRACKED = 10_000  # keys that a sketch follows


def large_keys(df: DataFrame, keys: list[str], rows: int = ROWS, tracked: int = TRACKED) -> DataFrame:
    """``(*keys, n)``: the keys with more than ``rows`` rows, and how many they have.

    One pass keeps a sketch of the most frequent hashes of keys in each task; sketches
    are merged in two steps. A second pass counts the rows of the candidates only. A key
    of less than about ``5 / tracked`` of all rows may be overlooked, which is no more
    than a task has of a large table anyway. The driver gets ``tracked / 4`` hashes at most.
    """
    hashed = df.select(*keys, F.xxhash64(*keys).alias("_hash"))
    step = hashed.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("_lot")).agg(
        F.expr(f"approx_top_k_accumulate(_hash, {tracked})").alias("_sketch")
    )
    every = F.expr(f"approx_top_k_estimate(approx_top_k_combine(_sketch, {tracked}), {tracked // 4})")
    step = step.withColumn("_lot", F.lit(0))
    merged = step.groupBy("_lot").agg(every.alias("top")).first()  # none for an empty table
    likely = [r["item"] for r in merged["top"] if r["count"] > rows] if merged else []
    if not likely:
        return df.select(*keys).limit(0).withColumn("n", F.lit(0).cast("bigint"))
    spark = df.sparkSession
    listed = spark.createDataFrame([(h,) for h in likely], "_hash bigint")
    some = hashed.join(F.broadcast(listed), "_hash", "left_semi")
    counted = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    path = scratch_path(spark, "large-keys")
    counted.write.parquet(path)
    return spark.read.schema(counted.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Bytes of a table as Spark estimates them when it plans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass(frozen=True)
class Pieces:
    """Rows with ``_piece`` and ``_continues``: a key goes on from an earlier piece.

    ``edges`` has one row for each piece of a key that lies in several: the keys,
    ``_piece`` and ``_continues``. A piece has two such keys at most, its first and
    its last. It is None without pieces.
    """

    rows: DataFrame
    edges: DataFrame | None


def cut(df: DataFrame, keys: list[str], order: str, rows_per_task: int | None = None) -> Pieces:
    """Number the pieces. ``order`` must not have ties in a key; nulls come first.

    With ``rows_per_task`` the rows are counted, sorted and written, so this runs
    jobs; the number of pieces follows the number of rows. Without it, so are the rows
    of large keys, if the table is large; all others are piece -1 as they are.
    """
    plain = df.withColumns({"_piece": F.lit(-1), "_continues": F.lit(False)})
    if rows_per_task is None:
        if plan_bytes(df) <= TABLE_BYTES:
            return Pieces(plain, None)
        large = large_keys(df, keys, ROWS)
        if large.isEmpty():
            return Pieces(plain, None)
        few = F.broadcast(large.select(*keys))  # no more than a sketch follows
        hot = cut(_joined(df, few, keys, "left_semi"), keys, order, ROWS)
        rest = _joined(plain, few, keys, "left_anti")
        return Pieces(rest.unionByName(hot.rows.select(*rest.columns)), hot.edges)
    if rows_per_task < 1:
        raise ValueError("rows_per_task must be at least 1")
    count = max(1, math.ceil(df.count() / rows_per_task))
    sorted_rows = df.repartitionByRange(count, *keys, order).sortWithinPartitions(*keys, order)
    numbered_rows = sorted_rows.withColumn("_piece", F.spark_partition_id())
    path = scratch_path(df.sparkSession, "pieces")
    numbered_rows.write.parquet(path)
    rows = df.sparkSession.read.schema(numbered_rows.schema).parquet(path)
    of_key = Window.partitionBy(*keys).orderBy("_piece")
    parts = rows.select(*keys, "_piece").distinct()
    parts = parts.withColumns(
        {
            "_continues": F.lag("_piece").over(of_key).isNotNull(),
            "_goes_on": F.lead("_piece").over(of_key).isNotNull(),
        }
    )
    edges = parts.filter(F.col("_continues") | F.col("_goes_on")).select(*keys, "_piece", "_continues")
    edge_path = scratch_path(df.sparkSession, "piece-edges")
    edges.write.parquet(edge_path)
    edges = df.sparkSession.read.schema(edges.schema).parquet(edge_path)
    joined = _joined(rows, edges, [*keys, "_piece"], "left")
    return Pieces(joined.withColumn("_continues", F.coalesce("_continues", F.lit(False))), edges)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by keys that may be null; the keys come from the left side."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_right_{key}")
    condition = None
    for key in keys:
        equal = left[key].eqNullSafe(renamed[f"_right_{key}"])
        condition = equal if condition is None else condition & equal
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])


def with_carry(
    pieces: Pieces, keys: list[str], order: str, count: int, where: Column | None = None
) -> DataFrame:
    """Rows plus, at the start of each piece of a key, the ``count`` rows before it.

    Only rows that satisfy ``where`` count. Added rows have ``_carried`` set; drop
    them after the window. Of each piece of a key that lies in several, the last
    ``count`` rows are numbered through; a piece fetches those whose numbers come
    right before its own.
    """
    rows = pieces.rows.withColumn("_carried", F.lit(False))
    if pieces.edges is None or count < 1:
        return rows
    columns = pieces.rows.columns
    wanted = pieces.rows if where is None else pieces.rows.filter(where)
    split = pieces.edges.select(*keys, "_piece")
    backwards = Window.partitionBy(*keys, "_piece").orderBy(F.col(order).desc())
    ends = (
        _joined(wanted, split, [*keys, "_piece"], "left_semi")
        .withColumn("_back", F.row_number().over(backwards))
        .filter(F.col("_back") <= count)
    )
    sizes = ends.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _joined(pieces.edges, sizes, [*keys, "_piece"], "left").withColumn(
        "_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0))
    )
    placed = _joined(ends, offsets.drop("_continues"), [*keys, "_piece"], "inner").withColumn(
        "_number", F.col("_before") + F.col("_n") - F.col("_back")
    )
    targets = offsets.filter("_continues AND _before > 0").select(
        *keys,
        F.col("_piece").alias("_target"),
        F.explode(
            F.sequence(F.greatest(F.lit(0), F.col("_before") - F.lit(count)), F.col("_before") - 1)
        ).alias("_number"),
    )
    carried = _joined(placed, targets, [*keys, "_number"], "inner")
    carried = carried.withColumns({"_piece": F.col("_target"), "_continues": F.lit(True)})
    return rows.unionByName(carried.select(*columns).withColumn("_carried", F.lit(True)))


def numbered(
    df: DataFrame, keys: list[str], order: str, name: str, rows_per_task: int | None = None
) -> DataFrame:
    """Row position (bigint, from 1) in each key, large keys spread over many tasks."""
    pieces = cut(df, keys, order, rows_per_task)
    window = Window.partitionBy(*keys, "_piece").orderBy(order)
    local = pieces.rows.withColumn(name, F.row_number().over(window).cast("bigint"))
    if pieces.edges is None:
        return local.drop("_piece", "_continues")
    split = _joined(pieces.rows, pieces.edges.select(*keys, "_piece"), [*keys, "_piece"], "left_semi")
    sizes = split.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_offset"))
    joined = _joined(local, offsets, [*keys, "_piece"], "left")
    shifted = (F.col(name) + F.coalesce("_offset", F.lit(0))).alias(name)
    return joined.select(*df.columns, shifted)
