"""Text tools: what a user's function makes of texts, as columns.

A tool takes texts and gives texts or records. Tools that are Spark expressions stay in
the plan (``native``); a user's function runs in tasks on Arrow batches, like a scorer:
a failing item does not spoil its batch, and failures are tried again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from msgrisk.operators.scoring import score_texts

NO_RECORD = "the tool gave no record"
NO_TOOL = "no such tool"


@dataclass(frozen=True)
class Tool:
    """A named tool. ``record`` is the DDL of the records it gives; without it, texts.

    ``run`` takes a list of texts and gives as many replies: texts, or mappings with the
    fields of the record. Fields that a reply lacks are null, others are left out.
    ``native`` builds a column from a column instead, of any type.
    """

    name: str
    run: Callable[[list[str]], list] | None = None
    record: str | None = None
    native: Callable[[Column], Column] | None = None
    attempts: int = 1

    def __post_init__(self):
        if (self.run is None) == (self.native is None):
            raise ValueError(f"the tool {self.name} needs a function or an expression")


def each(function: Callable[[str], object]) -> Callable[[list[str]], list]:
    """A tool's function from one that takes a single text."""
    return lambda texts: [function(t) for t in texts]


def with_tool(df: DataFrame, tool: Tool, text: str, into: str) -> DataFrame:
    """Add ``into``: struct ``result, error, attempts`` of a tool for each text.

    Null texts are not handed over: result and error are null, attempts 0. A tool that
    raises or gives no record where it should leaves a null result and says why.
    """
    value = F.col(text)
    if tool.native is not None:
        none = F.lit(None).cast("string")
        attempts = F.when(value.isNull(), 0).otherwise(1)
        made = F.when(value.isNotNull(), tool.native(value))
        return df.withColumn(into, F.struct(made.alias("result"), none.alias("error"), attempts.alias("attempts")))
    return df.withColumn(into, _called(tool)(value))


def _called(tool: Tool):
    kind = f"struct<{tool.record}>" if tool.record else "string"
    fields = StructType.fromDDL(tool.record).names if tool.record else None
    run, attempts = tool.run, tool.attempts

    def good(reply) -> bool:
        return reply is not None and (fields is None or isinstance(reply, Mapping))

    def shaped(reply):
        if fields is None:
            return None if reply is None else str(reply)
        return {n: reply.get(n) for n in fields}

    @F.pandas_udf(f"result {kind}, error string, attempts int")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = [(None, None, 0)] * len(batch)
            asked = [i for i, text in enumerate(batch) if text is not None]
            replies = score_texts([batch.iloc[i] for i in asked], run, good, attempts)
            for i, (reply, tried, error) in zip(asked, replies):
                if error is None and fields is not None and not good(reply):
                    reply, error = None, NO_RECORD
                rows[i] = (shaped(reply) if good(reply) else None, error, tried)
            yield pd.DataFrame(rows, columns=["result", "error", "attempts"])

    # A tool may have effects; it must not be called again by a plan's rewrites.
    return call.asNondeterministic()


def run_calls(
    messages: DataFrame, tools: list[Tool], keys: list[str], calls: str = "tool_calls",
    argument: str = "text",
) -> DataFrame:
    """One tool message per call that messages make: ``keys, position, tool_call_id, name, content, error``.

    ``calls`` is an array of structs with ``id, name`` and ``args``, a map of texts, as
    ``history.chat_messages`` takes them; a tool gets the argument that ``argument`` names.
    Content is the tool's text, or its record as JSON. A tool that is not there, and one
    that fails, answer with an error and no content. Each tool sees its own calls only.
    """
    listed = messages.select(*keys, F.posexplode(calls).alias("position", "_call")).select(
        *keys, "position", F.col("_call.id").alias("tool_call_id"), F.col("_call.name").alias("name"),
        F.try_element_at("_call.args", F.lit(argument)).alias("_text"),
    )
    names = [t.name for t in tools]
    if len(set(names)) < len(names):
        raise ValueError("two tools have the same name")
    wrong = ~F.coalesce(F.col("name").isin(names), F.lit(False))
    none = F.lit(None).cast("string")
    kept = [*keys, "position", "tool_call_id", "name"]
    parts = listed.filter(wrong).select(*kept, none.alias("content"), F.lit(NO_TOOL).alias("error"))
    for tool in tools:
        made = with_tool(listed.filter(F.col("name") == tool.name), tool, "_text", "_made")
        result = F.col("_made.result")
        plain = made.schema["_made"].dataType["result"].dataType.typeName() == "string"
        content = result if plain else F.to_json(result, {"ignoreNullFields": "false"})
        parts = parts.unionByName(made.select(*kept, content.alias("content"), F.col("_made.error").alias("error")))
    return parts
