"""Conversation history: the last messages up to each message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.functions import chat
from msgrisk.operators import splitting


def last_messages(
    df: DataFrame,
    keys: list[str],
    order: str,
    who: str = "who",
    text: str = "text",
    count: int = 3,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``last_messages`` (lines, oldest first) and the joined ``snippet``.

    The current message is the last line. Messages without text are left out,
    and so is an empty text that would open its conversation.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    columns = df.columns
    pieces = splitting.cut(df.filter(F.col(text).isNotNull()), keys, order, rows_per_task)
    # Both windows share one exchange and one sort.
    window = Window.partitionBy(*keys, "_piece").orderBy(order)
    first = (F.row_number().over(window) == 1) & ~F.col("_continues")
    opened = pieces.rows.withColumn("_opening", first)
    kept = opened.filter(~((F.col(text) == "") & F.col("_opening"))).drop("_opening")
    rows = splitting.with_carry(splitting.Pieces(kept, pieces.edges), keys, order, count - 1)
    lines = F.collect_list(chat.message_line(F.col(who), F.col(text))).over(
        window.rowsBetween(-(count - 1), 0)
    )
    return (
        rows.withColumn("last_messages", lines)
        .filter(~F.col("_carried"))
        .withColumn("snippet", F.array_join("last_messages", "\n"))
        .select(*columns, "last_messages", "snippet")
    )


def chat_messages(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add ``message``: each message in the notation of a chat model.

    That is role and content, with ``tool_calls`` and ``tool_call_id`` where the
    input has them. Each row is mapped by itself; messages of other roles are left
    out. ``requests`` puts messages together.
    """
    known = df.filter(F.lower(F.col(role)).isin(list(_ROLES)))
    return known.withColumn("message", chat_message(df, F.col(role), F.col(text)))


def requests(
    df: DataFrame, keys: list[str], order: str, count: int, role: str = "role",
    text: str = "text", rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``messages``: what a model is sent at each turn, as the caller limits it.

    That is the list of the last ``count`` messages, oldest first, the current one
    included.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    mapped = chat_messages(df, role, text)
    pieces = splitting.cut(mapped, keys, order, rows_per_task)
    rows = splitting.with_carry(pieces, keys, order, count - 1)
    window = Window.partitionBy(*keys, "_piece").orderBy(order)
    listed = F.collect_list("message").over(window.rowsBetween(-(count - 1), 0))
    with_list = rows.withColumn("messages", listed).filter(~F.col("_carried"))
    return with_list.select(*df.columns, "messages")


def chat_message(df: DataFrame, role: Column, text: Column) -> Column:
    """One message in the notation of a chat model."""
    role_names = F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair])
    fields = [
        F.try_element_at(role_names, F.lower(role)).alias("role"),
        F.coalesce(text, F.lit("")).alias("content"),
    ]
    if "tool_calls" in df.columns:
        fields.append(F.transform("tool_calls", _tool_call).alias("tool_calls"))
    if "tool_call_id" in df.columns:
        fields.append(F.col("tool_call_id"))
    return F.struct(*fields)


# Message roles, as sent and as they are called inside a chat framework.
_ROLES = {
    "system": "system",
    "user": "user",
    "human": "user",
    "assistant": "assistant",
    "ai": "assistant",
    "tool": "tool",
}


def _tool_call(call: Column) -> Column:
    function = F.struct(call["name"].alias("name"), F.to_json(call["args"]).alias("arguments"))
    return F.struct(
        call["id"].alias("id"), F.lit("function").alias("type"), function.alias("function")
    )
