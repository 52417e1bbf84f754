"""Column expressions that read model replies and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk import schemas
from msgrisk.functions.text import SPACE, let

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def strict_json(text: Column, schema: str) -> Column:
    """Record of a text that is one JSON object and nothing more, else null.

    Parsed as the only element of a list, because the parser would overlook
    whatever follows the first object of a text.
    """
    listed = F.concat(F.lit("["), text, F.lit("]"))
    parsed = F.from_json(listed, f"array<struct<{schema}>>", _STRICT)
    return let(parsed, lambda p: F.when(F.size(p) == 1, F.get(p, F.lit(0))))


def reply_content(envelope: Column) -> Column:
    """Text of the first choice of a model reply; null if absent or empty."""
    return F.nullif(F.get_json_object(envelope, "$.choices[0].message.content"), F.lit(""))


def strip_fence(text: Column) -> Column:
    """Remove a leading json fence and a closing fence, each if present."""
    text = F.regexp_replace(text, f"^```json[{SPACE}]*", "")
    return F.regexp_replace(text, f"[{SPACE}]*```\\z", "")


def json_slice(text: Column) -> Column:
    """First opening to last closing brace; empty if there is no such span."""
    return F.regexp_extract(text, "(?s)\\{.*\\}", 0)


def parse_verdict(text: Column) -> Column:
    """Verdict record inside a reply; null fields where nothing is readable."""
    return strict_json(json_slice(text), schemas.VERDICT)


def accepted_rating(rating: Column) -> Column:
    """A rating above zero, else 0."""
    return F.when(rating > 0, rating).otherwise(F.lit(0.0))


def verdict_rating(text: Column) -> Column:
    return accepted_rating(parse_verdict(text)["rating"])


def page_or_text(reply: Column, url: Column) -> Column:
    """A page reply as a record; a reply that is no JSON object becomes content."""
    parsed = strict_json(reply, schemas.PAGE_RECORD)
    none = F.lit(None).cast("string")
    wrapped = F.struct(
        url.alias("url"),
        none.alias("title"),
        reply.alias("content"),
        F.lit("success").alias("status"),
        none.alias("method"),
        none.alias("error"),
    )
    return F.coalesce(parsed, wrapped)
