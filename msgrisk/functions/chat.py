"""Column expressions for chat callbacks: text, keys, notices, alerts, replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk import rubric


def text_element(text: Column) -> Column:
    """One text element of a message body."""
    content = F.struct(
        text.alias("Text"),
        F.lit(None).cast("string").alias("Desc"),
        F.lit(None).cast("string").alias("Data"),
    )
    return F.struct(F.lit(rubric.TEXT_ELEMENT).alias("MsgType"), content.alias("MsgContent"))


def first_text(body: Column) -> Column:
    """Text of the first text element, null if that element carries none."""
    texts = F.filter(body, lambda e: e["MsgType"] == rubric.TEXT_ELEMENT)
    return F.get(texts, F.lit(0))["MsgContent"]["Text"]


def key_low(a: Column, b: Column) -> Column:
    """Smaller account of a pair; null unless both are known."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def key_high(a: Column, b: Column) -> Column:
    """Larger account of a pair; null unless both are known."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def conversation_key(a: Column, b: Column) -> Column:
    """Printed form of the pair. Group by the two accounts, not by this text."""
    return F.concat(key_low(a, b), F.lit("-"), key_high(a, b))


def message_line(who: Column, text: Column) -> Column:
    return F.concat(who, F.lit(": "), text)


def number_text(value: Column) -> Column:
    """A JSON number as it was written: no decimals for whole numbers."""
    whole = F.rint(value) == value
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def shown(value: Column) -> Column:
    """A value inside a text template, where an absent one reads None."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def notice_text(reasoning: Column, rating: Column, advice: Column) -> Column:
    return F.format_string(
        rubric.NOTICE_FORMAT, shown(reasoning), shown(number_text(rating)), shown(advice)
    )


def noticed_message(notice: Column, text: Column) -> Column:
    """Message text with the notice put before it."""
    return F.concat(notice, F.lit("\n"), shown(text))


def alert_text(sender: Column, notice: Column) -> Column:
    return F.format_string(rubric.ALERT_FORMAT, shown(sender), notice)


def alert_payload(receiver: Column, sender: Column, notice: Column, nonce: Column) -> Column:
    """JSON of the message an administrator sends to the receiver."""
    element = F.struct(
        F.lit(rubric.TEXT_ELEMENT).alias("MsgType"),
        F.struct(alert_text(sender, notice).alias("Text")).alias("MsgContent"),
    )
    return F.to_json(
        F.struct(
            F.lit(rubric.ALERT_SYNC_MACHINE).alias("SyncOtherMachine"),
            receiver.alias("To_Account"),
            nonce.alias("MsgRandom"),
            F.array(*[F.lit(c) for c in rubric.ALERT_FORBID]).alias("ForbidCallbackControl"),
            F.array(element).alias("MsgBody"),
        )
    )


def callback_kind(command: Column) -> Column:
    return (
        F.when(command == rubric.AFTER_SEND, "after")
        .when(command == rubric.BEFORE_SEND, "before")
        .otherwise("other")
    )


def response(error: Column, injected: Column) -> Column:
    """Callback response: reject, plain OK, or OK with a rewritten body."""
    return F.struct(
        F.when(error.isNull(), "OK").otherwise("FAIL").alias("ActionStatus"),
        F.coalesce(error, F.lit("")).alias("ErrorInfo"),
        F.when(error.isNull(), 0).otherwise(-1).alias("ErrorCode"),
        F.when(error.isNull() & injected.isNotNull(), F.array(text_element(injected))).alias(
            "MsgBody"
        ),
    )


def http_status(error: Column) -> Column:
    return F.when(error.isNull(), 200).otherwise(400)
