"""Scoring that keeps every reply: a text that has one is never asked about again.

Replies are an append-only table below a path the caller keeps, one row per model and
text, known by the text's digest and length. A run asks only for texts the table does
not have, and a task's replies are there as soon as the task has ended. So a job
that is cut off goes on where its finished tasks ended, and a lost executor repeats
no more than the tasks it had under way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk import files
from msgrisk.functions import verdicts
from msgrisk.operators.scoring import (
    ATTEMPTS,
    Scorer,
    readable_rating,
    reply_column,
)
from msgrisk.session import scratch_path

KEY = ["_digest", "_size"]
STORED = "_digest string, _size int, model string, reply string, attempts int, error string, accepted boolean"
TEXTS_PER_TASK = 200  # what a task asks for before its replies are kept
TASKS_PER_JOB = 10_000
FEW_KEYS = 100_000  # of pending texts, 7 MB of keys, that go to all tasks

# Each task's file becomes part of the table when the task ends, not when the job does.
# Stores with committers of their own may keep replies by job; nothing is lost then but
# what a cut-off job had asked.
_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def text_key(text: Column) -> dict[str, Column]:
    """What a text is known by; a missing text is the empty one."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return {"_digest": F.sha2(whole, 256), "_size": F.length(whole)}


def read_replies(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The kept replies, one row per model and text; none if there is no table yet.

    A job that was cut off may have left a reply twice. The accepted one counts, of
    several the one that took fewest attempts and comes first in text order.
    """
    if not files.names(spark, path):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(path)
    if model is not None:
        rows = rows.filter(F.col("model") == model)
    best = F.min(F.struct((~F.col("accepted")).alias("_not"), "attempts", "reply", "error")).alias("_best")
    found = rows.groupBy(*KEY, "model").agg(best)
    kept = found.select(*KEY, "model", "_best.reply", "_best.attempts", "_best.error", ~F.col("_best._not"))
    return kept.toDF(*KEY, "model", "reply", "attempts", "error", "accepted")


def ask(
    texts: DataFrame, scorer: Scorer, path: str, model: str, content: str = "content",
    accept: Callable[[str | None], bool] = readable_rating, attempts: int = ATTEMPTS,
    texts_per_task: int = TEXTS_PER_TASK, again: bool = False, empty: bool = False,
) -> int:
    """Ask about the texts that have no reply yet, and keep the replies.

    Returns how many texts were asked about. Missing texts are not, nor are empty ones
    unless ``empty`` is set. Texts whose replies were not accepted in ``attempts`` attempts count as answered, as a
    batch run rates them 0; ``again`` asks about those once more. Pending texts are
    dealt to tasks of about ``texts_per_task``, whatever their number: that is the most
    a lost task asks for twice. Many tasks run as several jobs, of ``TASKS_PER_JOB`` each.
    """
    spark = texts.sparkSession
    text = F.col(content).cast("string")
    some = F.col("_text").isNotNull() if empty else F.col("_text") != ""
    keyed = texts.select(text.alias("_text")).filter(some).withColumns(text_key(F.col("_text")))
    known = read_replies(spark, path, model)
    if again:
        known = known.filter("accepted")
    # Keys alone tell what is pending; only pending texts are moved.
    keys = scratch_path(spark, "pending-keys")
    keyed.select(*KEY).distinct().join(known.select(*KEY), KEY, "left_anti").write.parquet(keys)
    open_keys = spark.read.schema("_digest string, _size int").parquet(keys)
    count = open_keys.count()
    if not count:
        files.remove(spark, keys)
        return 0
    if count <= FEW_KEYS:
        pending = keyed.join(F.broadcast(open_keys), KEY, "left_semi").dropDuplicates(KEY)
    else:  # copies are combined where they are read
        pending = keyed.dropDuplicates(KEY).join(open_keys, KEY, "left_semi")
    pending = pending.select("_text", *KEY)
    _ask_all(pending, count, scorer, path, model, accept, attempts, texts_per_task)
    files.remove(spark, keys)
    return count


def _ask_all(
    pending: DataFrame, count: int, scorer: Scorer, path: str, model: str,
    accept: Callable[[str | None], bool], attempts: int, texts_per_task: int,
) -> None:
    """Ask about ``count`` texts in one job, or in several of ``TASKS_PER_JOB`` tasks."""
    spark = pending.sparkSession
    tasks = -(-count // texts_per_task)
    waves = -(-tasks // TASKS_PER_JOB)
    if waves == 1:
        _keep(pending.repartition(tasks, "_digest"), scorer, path, model, accept, attempts)
        return
    staged = scratch_path(spark, "pending")
    slot = F.pmod(F.xxhash64(*KEY), F.lit(waves)).cast("int").alias("_wave")
    pending.select("*", slot).write.partitionBy("_wave").parquet(staged)
    schema = pending.schema
    for wave in range(waves):
        some = spark.read.schema(schema).parquet(f"{staged}/_wave={wave}")
        dealt = some.repartition(-(-tasks // waves), "_digest")
        _keep(dealt, scorer, path, model, accept, attempts)
    files.remove(spark, staged)


def _keep(
    pending: DataFrame, scorer: Scorer, path: str, model: str,
    accept: Callable[[str | None], bool], attempts: int,
) -> None:
    """Ask about some texts and add the replies to the table."""
    scored = pending.withColumn("_scored", reply_column(F.col("_text"), scorer, accept, attempts))
    good = F.pandas_udf(lambda replies: replies.map(accept).astype(bool), "boolean")
    rows = scored.select(
        *KEY, F.lit(model).alias("model"), "_scored.reply", "_scored.attempts", "_scored.error",
        (F.col("_scored.error").isNull() & good("_scored.reply")).alias("accepted"),
    )
    rows.write.mode("append").options(**_BY_TASK).parquet(path)


def with_kept_reply(
    df: DataFrame, scorer: Scorer, path: str, model: str, text: str, into: str,
    accept: Callable[[str | None], bool] = readable_rating, attempts: int = ATTEMPTS, **options,
) -> DataFrame:
    """Add ``into``: struct ``reply, attempts, error`` as ``scoring.reply_column`` gives it.

    Asks for what the table at ``path`` lacks, then joins. A null text has a null reply.
    """
    ask(df, scorer, path, model, text, accept, attempts, empty=True, **options)
    known = read_replies(df.sparkSession, path, model)
    known = known.select(*KEY, F.struct("reply", "attempts", "error").alias("_found"))
    key = {n: F.when(F.col(text).isNotNull(), c) for n, c in text_key(F.col(text)).items()}
    joined = df.withColumns(key).join(known, KEY, "left")
    parts = ("reply", F.coalesce("_found.attempts", F.lit(0)).alias("attempts"), "error")
    found = [F.col(f"_found.{p}").alias(p) if isinstance(p, str) else p for p in parts]
    return joined.withColumn(into, F.struct(*found)).drop(*KEY, "_found")


def score_kept(
    df: DataFrame, scorer: Scorer, path: str, model: str, content: str = "content", **options
) -> DataFrame:
    """Add ``verdict, rating, attempts, error`` as ``score_batch`` does, from kept replies.

    Asks for what is missing first (``ask``, which takes the options) and then joins the
    table of replies by digest and length. Null and empty content is rated 0 without
    a call. Repeated rows share a reply; the join splits a text that holds a large
    share of the rows, as in ``score_batch``.
    """
    rows = df.drop("rating")
    ask(rows, scorer, path, model, content, **options)
    replies = read_replies(df.sparkSession, path, model).drop("model", "accepted")
    joined = rows.withColumns(text_key(F.col(content))).join(
        replies.select(*KEY, F.struct("reply", "attempts", "error").alias("_scored")), KEY, "left"
    )
    verdict = verdicts.parse_verdict(F.col("_scored.reply"))
    return (
        joined.withColumn("verdict", verdict)
        .withColumn("rating", verdicts.accepted_rating(F.col("verdict.rating")))
        .withColumn("attempts", F.coalesce("_scored.attempts", F.lit(0)))
        .withColumn("error", F.col("_scored.error"))
        .drop(*KEY, "_scored")
    )


def merge_small(spark: SparkSession, path: str, target: str) -> None:
    """The replies as a new table in few files: one row per model and text."""
    read_replies(spark, path).write.parquet(target)
