"""Chat callbacks: parse, validate, project, route and answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk import rubric, schemas
from msgrisk.functions import chat, grading, verdicts
from msgrisk.functions.text import let


def parse(df: DataFrame, body: str = "body") -> DataFrame:
    """Add the parsed request ``data`` and flat columns; other columns stay."""
    parsed = df.withColumn("data", verdicts.strict_json(F.col(body), schemas.CALLBACK_BODY))
    return (
        parsed.withColumn("from_account", F.col("data.From_Account"))
        .withColumn("to_account", F.col("data.To_Account"))
        .withColumn("msg_seq", F.col("data.MsgSeq"))
        .withColumn("msg_time", F.timestamp_seconds("data.MsgTime"))
        .withColumn("event_time", F.timestamp_millis("data.EventTime"))
        .withColumn("text", chat.first_text(F.col("data.MsgBody")))
    )


def validate(df: DataFrame, app_id: str, body: str = "body") -> DataFrame:
    """Add ``error_info``: the first failed check of a parsed request, null if none.

    A body that is missing, unreadable or an empty object is no content, and
    neither is one without both accounts.
    """
    app, platform = F.col("SdkAppid"), F.col("OptPlatform")
    known = F.coalesce(platform.isin(rubric.PLATFORMS), F.lit(False))
    # One mention of the parsed body only: filters on this column are pushed
    # below the parsing and would repeat it for each.
    usable = let(
        F.col("data"), lambda d: d["From_Account"].isNotNull() & d["To_Account"].isNotNull()
    )
    error = (
        F.when(app.isNull() | (app == ""), rubric.REJECT_NO_APP)
        .when(app != app_id, rubric.REJECT_BAD_APP)
        .when(~known, rubric.REJECT_PLATFORM)
        .when(~F.coalesce(usable, F.lit(False)), rubric.REJECT_BODY)
    )
    return df.withColumn("error_info", error)


def accepted(df: DataFrame) -> DataFrame:
    """Requests that passed all checks."""
    return df.filter(F.col("error_info").isNull())


def rejected(df: DataFrame) -> DataFrame:
    """Requests that failed a check, with the reason."""
    return df.filter(F.col("error_info").isNotNull())


def keyed(df: DataFrame) -> DataFrame:
    """Add the conversation: both accounts in order, and the printed key."""
    a, b = F.col("from_account"), F.col("to_account")
    return (
        df.withColumn("account_low", chat.key_low(a, b))
        .withColumn("account_high", chat.key_high(a, b))
        .withColumn("conversation", chat.conversation_key(a, b))
    )


def routed(df: DataFrame, command: str = "CallbackCommand") -> DataFrame:
    """Add ``kind``: after, before or other."""
    return df.withColumn("kind", chat.callback_kind(F.col(command)))


def tiered(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Add ``tier``. Only after-send events (``kind``) call for an action."""
    tier = F.when(F.col("kind") == "after", grading.action_tier(F.col(rating))).otherwise("none")
    return df.withColumn("tier", tier)


def alerts(df: DataFrame, nonce: Column | None = None) -> DataFrame:
    """One admin message for each after-send event rated 4 or higher.

    Expects ``kind, from_account, to_account, rating, reasoning, advice``. The
    payload goes to the receiver; ``nonce`` is random unless given.
    """
    if nonce is None:
        nonce = F.floor(F.rand() * 10_000_000 + 1).cast("bigint")
    notice = chat.notice_text(F.col("reasoning"), F.col("rating"), F.col("advice"))
    return df.filter((F.col("kind") == "after") & (F.col("rating") >= 4)).withColumn(
        "payload",
        chat.alert_payload(F.col("to_account"), F.col("from_account"), notice, nonce),
    )


def respond(df: DataFrame) -> DataFrame:
    """Add the response to each callback.

    Expects ``error_info``, ``notice`` (null where none is shown) and ``text``.
    """
    injected = F.when(
        F.col("notice").isNotNull(), chat.noticed_message(F.col("notice"), F.col("text"))
    )
    return df.withColumn(
        "response", chat.response(F.col("error_info"), injected)
    ).withColumn("http_status", chat.http_status(F.col("error_info")))
