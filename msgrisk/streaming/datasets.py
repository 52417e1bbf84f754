"""Scoring of datasets as they arrive, with progress kept in a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from msgrisk.operators.replies import score_kept
from msgrisk.operators.scoring import Scorer, score_batch
from msgrisk.sources.datasets import read_datasets


def stream_datasets(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """The dataset files of a folder in the order they arrive, one row each.

    Only their paths are streamed; a micro-batch reads its files by itself, each in
    its charset and with its columns by name.
    """
    listed = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(listed)
    files = files.option("maxFilesPerTrigger", files_per_batch)
    return files.load(path).select(F.col("path").alias("file"))


def score_stream(
    files: DataFrame, scorer: Scorer, model: str, path: str, checkpoint: str,
    replies: str | None = None,
) -> StreamingQuery:
    """Score what has arrived since the last run and add it to the results.

    Each micro-batch writes a folder of its own, all columns of the files included,
    and writes it anew if it is run again. A run that is cut off goes on where its
    last finished micro-batch ended. With ``replies``, the path of a table of replies,
    it asks about no text that has one, also not about those of an unfinished batch.
    """

    def score(batch: DataFrame, number: int) -> None:
        found = [row["file"] for row in batch.collect()]  # at most files_per_batch
        if not found:
            return
        rows = read_datasets(batch.sparkSession, found)
        if replies is None:
            scored = score_batch(rows, scorer, distinct=False)
        else:
            scored = score_kept(rows, scorer, replies, model)
        flat = scored.withColumn("model", F.lit(model)).drop("verdict", "attempts", "error")
        flat.write.mode("overwrite").partitionBy("dataset", "model").parquet(f"{path}/batch={number}")

    return (
        files.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What has been scored so far; columns that some files lack are null there."""
    rows = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(f"{path}/batch=*")
    return rows.drop("batch").withColumns({c: F.col(c).cast("string") for c in ("dataset", "model")})
