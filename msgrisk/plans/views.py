"""Message-risk inputs derived from the given tables, row by row.

The tables hold no chats with ratings, so each view reads a whole table and
computes the columns an operator needs. Remainders below only choose values,
never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions import chat
from msgrisk.session import SPREAD

APP_ID = "app"

# Terms that occur in the invented prose, under the rubric's group names.
PROSE_TERMS = {
    "transfer": ["free", "token", "para"],
    "software": ["license", "mail", "con"],
    "identity": ["from", "avec", "für"],
    "threat": ["nicht", "dans"],
    "lure": ["that", "pour", "with"],
}
PROSE_SIGNS = {
    1: ["from", "pour"],
    2: ["that", "nicht"],
    3: ["with", "dans"],
    4: ["license", "mail"],
    5: ["free", "token"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work that costs more than reading it.

    Where the tables lie in few row groups, the owner of the session may ask for a
    number of partitions; by itself nothing is shuffled, whatever the size.
    """
    rows = table(spark, sf_dir, name).select(*columns)
    partitions = spark.conf.get(SPREAD, None)
    return rows.repartition(int(partitions)) if partitions else rows


def rated(
    spark: SparkSession, sf_dir: str, items: DataFrame | None = None, *more: str
) -> DataFrame:
    """Pairs of a human and a model rating per sheet, with halves and gaps."""
    items = table(spark, sf_dir, "lineitem") if items is None else items
    return items.select(
        *more,
        F.col("l_returnflag").alias("sheet"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 10).alias("human rating"),
        (F.col("l_discount") * 50).alias("rating"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def _pick(values: list[str | None]) -> Column:
    return _pick_by(values, F.col("event_id"))


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, read to its end."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(
        sf_dir
    )


def chat_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Chat events with accounts, kind, text and (mostly) a rating."""
    events = table(spark, sf_dir, "events") if events is None else events
    command = (
        F.when(F.col("event_type").isin("view", "click"), rubric.BEFORE_SEND)
        .when((F.col("event_type") == "error") & _every(5), "Group.CallbackAfterSendMsg")
        .otherwise(rubric.AFTER_SEND)
    )
    rating = F.when(F.col("event_id") % 7 != 3, F.col("value").cast("int") % 5 + 1)
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id")).alias("from_account"),
        F.concat(F.lit("u"), F.col("user_id") + 1 + F.col("event_id") % 3).alias("to_account"),
        command.alias("command"),
        chat.callback_kind(command).alias("kind"),
        F.concat_ws(" ", F.lit("msg"), "event_type", "props").alias("text"),
        rating.cast("double").alias("rating"),
        F.concat(F.lit("seen "), F.col("event_type")).alias("reasoning"),
        F.col("props").alias("advice"),
    )


def callback_requests(
    spark: SparkSession, sf_dir: str, events: DataFrame | None = None
) -> DataFrame:
    """Raw requests as a chat server sends them, good and bad ones.

    Beside each lies the verdict on its message, as a scorer gave it.
    """
    events = chat_events(spark, sf_dir, events)
    none = F.lit(None).cast("string")
    custom = F.struct(
        F.lit("TIMCustomElem").alias("MsgType"),
        F.struct(
            none.alias("Text"), F.lit("level").alias("Desc"), F.lit("LV1").alias("Data")
        ).alias("MsgContent"),
    )
    text = chat.text_element(F.col("text"))
    shape = F.col("event_id") % 6
    body = (
        F.when(shape == 0, F.array(text))
        .when(shape == 1, F.array(custom, text))
        .when(shape == 2, F.array(text, chat.text_element(F.lit("second"))))
        .when(shape == 3, F.array(chat.text_element(none)))
        .when(shape == 4, F.slice(F.array(text), 1, 0))
    )
    request = F.struct(
        F.col("command").alias("CallbackCommand"),
        F.when(~_every(37), F.col("from_account")).alias("From_Account"),
        F.col("to_account").alias("To_Account"),
        F.col("event_id").alias("MsgSeq"),
        F.unix_seconds("ts").alias("MsgTime"),
        body.alias("MsgBody"),
        F.unix_millis("ts").alias("EventTime"),
    )
    app = F.when(_every(13), none).when(_every(17), "").when(_every(19), "bad").otherwise(APP_ID)
    raw = (
        F.when(_every(23), none)
        .when(_every(29), "{}")
        .when(_every(31), "no json")
        .otherwise(F.to_json(request))
    )
    return events.select(
        "event_id",
        app.alias("SdkAppid"),
        F.col("command").alias("CallbackCommand"),
        _pick(["RESTAPI", "Web", "Android", "iOS", "Toaster", None, "Unknown"]).alias("OptPlatform"),
        raw.alias("body"),
        "rating",
        "reasoning",
        "advice",
    )


def linked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per page, with its link, its host and some dead links."""
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    dead = F.when(F.col("page_id") % 5 == 0, "-gone").otherwise("")
    text = F.concat(F.lit("free: see "), F.col("url"), dead, F.lit(" or "), host, F.lit(", now"))
    return pages.select(F.col("page_id").alias("msg_id"), text.alias("text"))


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model in eight shapes, some of them unreadable."""
    events = table(spark, sf_dir, "events")
    number = (F.col("value").cast("int") % 8).cast("string")
    shape = F.col("event_id") % 8

    def wrap(before: str, after: str) -> Column:
        return F.concat(F.lit(before), number, F.lit(after))

    reply = (
        F.when(shape == 0, wrap('{"rating": ', ', "advice": "wait"}'))
        .when(shape == 1, wrap('```json\n{"rating": ', ', "advice": "wait"}\n```'))
        .when(shape == 2, wrap('I think {"rating": ', '.5, "advice": "wait"} fits'))
        .when(shape == 3, wrap("rating ", ""))
        .when(shape == 4, wrap("} rating ", " {"))
        .when(shape == 5, wrap('{"rating": "', '"}'))
        .when(shape == 6, F.lit('{"advice": "wait"}'))
        .otherwise(wrap('{"rating": [', "]}"))
    )
    return events.select("event_id", reply.alias("reply"))


def sheet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        (F.col("o_orderkey") % 3).alias("sheet"),
        F.col("o_orderkey").alias("position"),
        F.col("o_orderpriority").alias("content"),
        (F.floor(F.col("o_totalprice") / 50000) / 2).alias("rating"),
    )


def sheet_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        (F.col("event_id") % 3).alias("sheet"),
        F.col("event_id").alias("position"),
        (F.col("value") / 50).alias("rating"),
    )


RUBRIC_SIGNS = [sign for signs in rubric.SCAM_SIGNS.values() for sign in signs]
RUBRIC_TERMS = [term for terms in rubric.RISK_KEYWORDS.values() for term in terms]


def rubric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events told with two signs and one keyword of the rubric each."""
    events = table(spark, sf_dir, "events")
    text = F.concat_ws(
        " ",
        _pick_by(RUBRIC_SIGNS, F.col("event_id")),
        _pick_by(RUBRIC_SIGNS, F.col("user_id") * 7 + F.col("event_id")),
        _pick_by(RUBRIC_TERMS, F.col("user_id") * 3 + F.col("event_id")),
        "event_type",
    )
    return events.select("event_id", text.alias("text"))


def _pick_by(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int") + 1)
