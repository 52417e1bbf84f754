"""Chat monitoring as a stream: history, scoring and one-shot notices per conversation.

Each micro-batch is a table: the windows of the batch operators run over it, and
what they need from before comes in as one row of state per conversation. State
lies beside the results and grows by what a batch changes (``state.KeyedState``); a
batch that is run again finds the state it had and writes the same folders anew.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from msgrisk import files, schemas
from msgrisk.functions import chat, grading, verdicts
from msgrisk.operators import callbacks, splitting
from msgrisk.operators.answers import PAIR
from msgrisk.operators.replies import with_kept_reply
from msgrisk.operators.scoring import Scorer, any_text, reply_column
from msgrisk.operators.splitting import Pieces
from msgrisk.session import scratch_path
from msgrisk.streaming.state import BUCKETS, KeyedState

EVENT = [
    "from_account", "to_account", "event_time", "msg_seq", "kind", "text",
    "rating", "reasoning", "advice",
]
ORDER = ["event_time", "msg_seq"]
AT = "_at"  # both as one
STATE = "lines array<string>, started boolean, due string, seen timestamp"


def with_history(pieces: Pieces, keys: list[str], count: int) -> Pieces:
    """Add ``last_messages`` to the after-send events with text, from rows and state."""
    said = F.coalesce((F.col("kind") == "after") & F.col("text").isNotNull(), F.lit(False))
    window = Window.partitionBy(*keys, "_piece").orderBy(AT)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    opens = ~(F.coalesce(F.max(said).over(before), F.lit(False)) | F.col("_state.started"))
    rows = splitting.with_carry(pieces, keys, AT, 1, where=said)
    rows = rows.withColumn("_line", said & ~((F.col("text") == "") & opens))
    rows = rows.filter(~F.col("_carried")).drop("_carried")
    rows = splitting.with_carry(Pieces(rows, pieces.edges), keys, AT, count - 1, where=F.col("_line"))
    line = F.when(F.col("_line"), chat.message_line(F.col("from_account"), F.col("text")))
    # Numbered lines bound the frame, whatever lies between them.
    rows = rows.withColumns({"_text": line, "_number": F.count_if("_line").over(window)})
    near = Window.partitionBy(*keys, "_piece").orderBy("_number").rangeBetween(-(count - 1), 0)
    own = F.collect_list("_text").over(near)
    # Where a piece is handed fewer lines than fit, there were none but those of the state.
    both = F.concat("_state.lines", own)
    kept = F.slice(both, F.greatest(F.lit(1), F.size(both) - (count - 1)), F.lit(count))
    rows = rows.withColumn("last_messages", F.when(F.col("_line"), kept)).filter(~F.col("_carried"))
    return Pieces(rows.drop("_line", "_text", "_number", "_carried"), pieces.edges)


def with_verdicts(
    rows: DataFrame, scorer: Scorer, path: str, kept: str | None = None
) -> DataFrame:
    """Replace ``rating, reasoning, advice`` by what the scorer says of each history.

    ``error`` and ``error_message`` tell of a scorer that failed, as in batch scoring;
    such an event has no rating. Histories go to the scorer in Arrow
    batches. The scored rows are written to ``path``, as a scorer must not be asked twice.
    With a table of replies, ``kept``, it is not asked about a history that has one either.
    """
    snippet = F.when(F.size("last_messages") > 0, F.array_join("last_messages", "\n"))
    if kept is None:
        asked = rows.withColumn("_scored", reply_column(snippet, scorer, accept=any_text, attempts=1))
    else:
        shown_to = rows.withColumn("_snippet", snippet)
        asked = with_kept_reply(shown_to, scorer, kept, "monitor", "_snippet", "_scored", any_text, 1)
        asked = asked.select(*rows.columns, "_scored")
    asked.write.parquet(path)
    scored = rows.sparkSession.read.schema(asked.schema).parquet(path)
    reply = verdicts.strip_fence(F.col("_scored.reply"))
    scored = scored.withColumn("_verdict", verdicts.strict_json(reply, schemas.VERDICT))
    fields = {n: F.col(f"_verdict.{n}") for n in ("rating", "reasoning", "advice")}
    failed = F.col("_scored.error").isNotNull()
    fields["error"] = F.when(failed, "agent_failure")
    fields["error_message"] = F.col("_scored.error")
    return scored.withColumns(fields).drop("_scored", "_verdict")


def _due() -> Column:
    level = F.col("rating")
    text = chat.notice_text(F.col("reasoning"), level, F.col("advice"))
    return F.when((F.col("kind") == "after") & (level >= 3), text)


def _matters() -> Column:
    rated = (F.col("kind") == "after") & F.col("rating").isNotNull()
    return (F.col("kind") == "before") | rated


def with_notices(pieces: Pieces, keys: list[str]) -> DataFrame:
    """Add ``notice`` to the before-send events that must show one."""
    rows = splitting.with_carry(pieces, keys, AT, 1, where=_matters())
    window = Window.partitionBy(*keys, "_piece").orderBy(AT)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(F.when(_matters(), F.struct(_due().alias("due"))), ignorenulls=True).over(before)
    due = F.when(previous.isNull(), F.col("_state.due")).otherwise(previous["due"])
    rows = rows.withColumn("notice", F.when(F.col("kind") == "before", due))
    return rows.filter(~F.col("_carried")).drop("_carried", "_piece", "_continues", AT)


def next_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each conversation after its rows."""
    at = F.struct(*ORDER)
    said = (F.col("kind") == "after") & F.col("text").isNotNull()
    listed = F.when(F.col("last_messages").isNotNull(), at)
    matters = F.when(_matters(), at)
    found = rows.groupBy(*keys).agg(
        F.max_by("last_messages", listed).alias("_lines"),
        F.max_by(F.struct(_due().alias("due")), matters).alias("_due"),
        F.bool_or(F.coalesce(said, F.lit(False))).alias("_started"),
        F.max("event_time").alias("_seen"),
        F.first("_state").alias("_state"),
    )
    return found.select(
        *keys,
        F.coalesce("_lines", "_state.lines").alias("lines"),
        (F.col("_started") | F.col("_state.started")).alias("started"),
        F.when(F.col("_due").isNull(), F.col("_state.due")).otherwise(F.col("_due.due")).alias("due"),
        F.greatest("_seen", "_state.seen").alias("seen"),
    )


def shown(rows: DataFrame) -> DataFrame:
    """Add the action tier of after-send events and the response to each event."""
    tier = F.when(F.col("kind") == "after", grading.action_tier(F.col("rating"))).otherwise("none")
    message = F.when(
        F.col("notice").isNotNull(), chat.noticed_message(F.col("notice"), F.col("text"))
    )
    response = chat.response(F.lit(None).cast("string"), message)
    return rows.withColumns({"tier": tier, "response": response})


def step(
    events: DataFrame, state: DataFrame, keys: list[str], scorer: Scorer | None, count: int,
    staged: str, kept: str | None = None,
) -> DataFrame:
    """One micro-batch with its history, ratings and notices, and ``_state`` beside it.

    A scorer's replies are kept below ``staged``. Of a large micro-batch the large
    conversations are cut into pieces (``operators.splitting``).
    """
    held = state.select(*keys, F.struct("lines", "started", "due", "seen").alias("_state"))
    none = F.array().cast("array<string>")
    fresh = F.struct(
        none.alias("lines"), F.lit(False).alias("started"), F.lit(None).cast("string").alias("due"),
        F.lit(None).cast("timestamp").alias("seen"),
    )
    pieces = splitting.cut(events.withColumn(AT, F.struct(*ORDER)), keys, AT)
    rows = pieces.rows.join(held, keys, "left").withColumn("_state", F.coalesce("_state", fresh))
    rows = rows.select(*pieces.rows.columns, "_state")
    rows = with_history(Pieces(rows, pieces.edges), keys, count).rows
    if scorer is not None:
        rows = with_verdicts(rows, scorer, f"{staged}/scored", kept)
    else:
        none = F.lit(None).cast("string")
        rows = rows.withColumns({"error": none, "error_message": none})
    return with_notices(Pieces(rows, pieces.edges), keys)


def monitor(
    events: DataFrame,
    path: str,
    checkpoint: str,
    scorer: Scorer | None = None,
    count: int = 3,
    keys: list[str] | None = None,
    idle_hours: float = 24.0,
    once: bool = True,
    seconds: int = 10,
    buckets: int = BUCKETS,
    nonce: Column | None = None,
    replies: str | None = None,
) -> StreamingQuery:
    """Write each event with its history, rating and, where one is due, the notice.

    ``events`` brings the columns of ``EVENT`` and, unless conversations are account
    pairs, the columns ``keys`` that tell them apart. Without a scorer the ratings in
    the input count. State is ``count`` lines and one notice per conversation and goes
    ``idle_hours`` after the last event, by event time; it is dealt to ``buckets``, of
    which a micro-batch reads and writes those of its conversations. A micro-batch is
    read from its source once and written below the shared folder, so the source should
    limit its bytes. With ``once`` the query takes what is there and ends. ``read_results`` reads what has been written.
    The admin messages that its ratings call for are written too, with each micro-batch
    (``stream_alerts``, ``read_alerts``); their ``nonce`` is a hash of the event, so a
    batch that is run again writes the same messages. With ``replies``, the path of a table
    of replies, such a batch asks the scorer nothing that has been answered.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    by = list(keys or PAIR)
    keyed = events.select(*EVENT, *(keys or ()))
    if not keys:
        keyed = callbacks.keyed(keyed).drop("conversation")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = batch
        for key in by:
            known = known.filter(F.col(key).isNotNull())
        state = KeyedState(
            spark, f"{path}/state", StructType([known.schema[k] for k in by]),
            StructType.fromDDL(STATE), "seen", timedelta(hours=idle_hours), buckets,
        )
        staged = scratch_path(spark, "monitor-step")
        known.write.parquet(f"{staged}/events")
        known = spark.read.schema(known.schema).parquet(f"{staged}/events")
        made = step(known, state.before(number, known), by, scorer, count, staged, replies)
        made.write.parquet(f"{staged}/rows")
        rows = spark.read.schema(made.schema).parquet(f"{staged}/rows")
        done = shown(rows).drop("_state")
        done.write.mode("overwrite").parquet(f"{path}/rows/step={number}")
        own = F.pmod(F.xxhash64(*by, *ORDER), F.lit(10_000_000)) + 1
        sent = callbacks.alerts(done, own if nonce is None else nonce)
        sent.write.mode("overwrite").parquet(f"{path}/alerts/step={number}")
        state.commit(number, next_state(rows, by))
        files.remove(spark, staged)

    writer = keyed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All rows that the monitor has written so far."""
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/step=*").drop("step")


def alerts(monitored: DataFrame) -> DataFrame:
    """Admin messages for monitored events."""
    return callbacks.alerts(monitored)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All admin messages that the monitor has written so far: its rows with ``payload``."""
    return spark.read.option("basePath", f"{path}/alerts").parquet(f"{path}/alerts/step=*").drop("step")


def stream_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The admin messages as a stream, for a delivery service; needs a monitor that has run."""
    schema = spark.read.parquet(f"{path}/alerts/step=*").schema
    return spark.readStream.schema(schema).option("basePath", f"{path}/alerts").parquet(f"{path}/alerts/step=*")


def rejections(checked: DataFrame) -> DataFrame:
    """Responses to the requests that never reach the monitor."""
    none = F.lit(None).cast("string")
    return callbacks.rejected(checked).withColumn(
        "response", chat.response(F.col("error_info"), none)
    )


def append(
    stream: DataFrame, path: str, checkpoint: str, once: bool = True, seconds: int = 10
) -> StreamingQuery:
    """Append a stream to a parquet table, exactly once across restarts.

    With ``once`` the query takes all that is there, in micro-batches, and ends.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()
