"""What the two classifiers share: labelled samples, sparse rows, and scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    StructField,
    StructType,
)

from msgrisk.llm.common import column, map_rows

SAMPLE = 16_000  # labelled rows a model is fitted on, at most
THRESHOLD = 0.3


def remainder(id_column: Column, folds: int) -> Column:
    return F.crc32(id_column.cast("string")) % folds


@dataclass
class Rows:
    """Sets of features as one list of numbers and where each row starts."""

    features: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        lengths = np.array([len(r) for r in rows], np.int64)
        features = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
        return cls(features, np.append(0, np.cumsum(lengths)))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def only(self, wanted: np.ndarray) -> Rows:
        """The rows with those features only that are marked."""
        kept = wanted[self.features]
        return Rows(self.features[kept], np.append(0, np.cumsum(kept))[self.starts])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of weights of each row's features."""
        totals = np.append(0.0, np.cumsum(weights[self.features], dtype=np.float64))
        return totals[self.starts[1:]] - totals[self.starts[:-1]]

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """The sum over rows of a row's value, for each feature."""
        return np.bincount(self.features, np.repeat(values, np.diff(self.starts)), minlength=size)


def class_counts(rows: Rows, positive: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of each of the two classes have a feature."""
    hits, misses = np.zeros(size), np.zeros(size)
    for start in range(0, len(rows), 500):  # bincount makes wide copies of what it counts
        part = slice(start, start + 500)
        a, b = rows.starts[start], rows.starts[min(start + 500, len(rows))]
        features = rows.features[a:b]
        marked = np.repeat(positive[part], np.diff(rows.starts)[part])
        hits += np.bincount(features[marked], minlength=size)
        misses += np.bincount(features[~marked], minlength=size)
    return hits, misses


def log_ratios(rows: Rows, positive: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of a feature's shares in the two classes."""
    p, q = (smooth + n for n in class_counts(rows, positive, size))
    p, q = p / (2 * smooth + positive.sum()), q / (2 * smooth + (~positive).sum())
    return np.log(p / q)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, extract: Callable,
    id_column: str = "doc_id", text_column: str = "text", limit: int = SAMPLE,
) -> list[tuple[bytes, int]]:
    """Feature sets and labels of at most ``limit`` labelled documents to learn from.

    Rows of the held-out fold, with a null id or without a label of 0 or 1 take no
    part. An id with several labels counts by their mean, an id with several texts by
    one of them. Which rows are taken depends on a hash of the id only. The list of
    ids is bounded by ``limit``, so it is broadcast; texts are not moved.
    """
    train = (
        labels.select(F.col(id_column).alias("id"), F.col(label).alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .where(remainder(F.col("id"), folds) != held_out)
        .groupBy("id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    present = docs.select(F.col(id_column).alias("id")).distinct()
    sample = train.join(present, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = texts.join(F.broadcast(sample), "id")
    schema = StructType([
        StructField("id", docs.schema[id_column].dataType), StructField("label", IntegerType()),
        StructField("features", BinaryType()),
    ])

    def make():
        work_on = extract()

        def work(batch):
            found = [work_on(t or "").astype("<i4").tobytes() for t in column(batch, "text")]
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in ("id", "label")}
            yield columns | {"features": found}

        return work

    features = map_rows(rows, make, schema, 500)
    once = features.groupBy("id").agg(F.min("label").alias("label"), F.min("features").alias("features"))
    taken = once.orderBy("id").toArrow()
    return list(zip(taken["features"].to_pylist(), taken["label"].to_pylist()))


def unpacked(sample: list[tuple[bytes, int]]) -> tuple[Rows, np.ndarray]:
    rows = Rows.of([np.frombuffer(f, "<i4") for f, _ in sample])
    return rows, np.array([label == 1 for _, label in sample], bool)


@dataclass
class Model:
    """A weight for each feature, an intercept, and how margins become scores."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, rows: Rows) -> np.ndarray:
        margin = self.slope * (rows.sums(self.weights) + self.intercept) + self.offset
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def calibrated(model: Model, rows: Rows, positive: np.ndarray) -> Model:
    """Fit slope and offset of a logistic curve through the margins (Newton steps)."""
    margin = rows.sums(model.weights) + model.intercept
    n, p = len(positive), int(positive.sum())
    target = np.where(positive, (p + 1) / (p + 2), 1 / (n - p + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        guess = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
        error, spread = guess - target, guess * (1 - guess) + 1e-9
        gradient = np.array([error @ margin + 1e-3 * (slope - 1), error.sum()])
        cross = spread @ margin
        matrix = np.array([[spread @ margin**2 + 1e-3, cross], [cross, spread.sum() + 1e-3]])
        step = np.linalg.solve(matrix, gradient)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return Model(model.weights, model.intercept, max(slope, 1e-6), offset)


def scored(
    docs: DataFrame, model: Model, extract: Callable, text_column: str = "text",
    threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted",
) -> DataFrame:
    """All rows and columns with a score from 0 to 1 and whether it reaches the threshold.

    A null text is scored as an empty one. The model has a fixed size and is broadcast.
    The names of the new columns are parameters; ones that the table has are an error.
    """
    names = docs.schema.names
    if taken := {score.lower(), predicted.lower()} & {n.lower() for n in names}:
        raise ValueError(f"the table has columns of these names already: {sorted(taken)}")
    schema = StructType([
        *docs.schema.fields, StructField(score, DoubleType()), StructField(predicted, IntegerType()),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        work_on, fitted = extract(), shared.value

        def work(batch: pa.RecordBatch):
            rows = Rows.of([work_on(t or "") for t in column(batch, text_column)])
            found = fitted.scores(rows)
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            yield columns | {score: found, predicted: (found >= threshold).astype(np.int32)}

        return work

    return map_rows(docs, make, schema, 1000)


def fold_columns(docs: DataFrame, folds: int, held_out: int, id_column: str = "doc_id") -> Column:
    return F.coalesce(remainder(F.col(id_column), folds) == held_out, F.lit(False)).cast(BooleanType())
