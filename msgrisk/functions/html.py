"""Column expressions that turn HTML into the text and title of a page."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions.text import LINE_END, SPACE, head, let, strip

# Elements whose content is no page text, and markup that is none either. One
# alternation, so that a comment inside a script (or the reverse) is no problem.
_HIDDEN = (
    "(?is)<(?:script\\b[^>]*>.*?(?:</script\\s*>|\\z)"
    "|style\\b[^>]*>.*?(?:</style\\s*>|\\z)"
    "|template\\b[^>]*>.*?(?:</template\\s*>|\\z)"
    "|rt\\b[^>]*>.*?(?:</rt\\s*>|\\z)"
    "|rp\\b[^>]*>.*?(?:</rp\\s*>|\\z)"
    "|!--.*?-->"
    "|[!?][^>]*>)"
)
# A tag; quoted attribute values may hold a closing bracket.
_TAG = "(?s)</?[A-Za-z](?:(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>|[^>]*>)"
_TITLE = "(?is)<title\\b[^>]*>(.*?)(?:</title\\s*>|\\z)"
_ENTITY = "^(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][-.A-Za-z0-9]*);?"

_COMMON = ["amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "hellip", "mdash"]


def entity_table() -> dict[str, str]:
    """Named entities of the HTML standard, the common ones first."""
    known = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    return {**{k: known[k] for k in _COMMON}, **known}


def _control_table() -> dict[str, str]:
    """Numbers 128 to 159, which pages use in the sense of Windows-1252."""
    return {
        str(n): bytes([n]).decode("cp1252", errors="replace") for n in range(128, 160)
    }


def _literal_map(table: dict[str, str]) -> Column:
    # Folded by the optimizer into one map literal.
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _code_point(number: Column) -> Column:
    """Character of a code point; the replacement character if there is none."""
    plain = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number < 0x110000))
    as_bytes = F.unhex(F.lpad(F.hex(number), 8, "0"))
    exact = F.when(plain, F.decode(as_bytes, "UTF-32"))
    return F.coalesce(
        F.try_element_at(_literal_map(_control_table()), number.cast("string")),
        exact,
        F.lit("\N{REPLACEMENT CHARACTER}"),
    )


def _number(digits: Column, base: int) -> Column:
    """Value of the digits, -1 if beyond the range of a code point."""
    trimmed = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(trimmed) > 8, F.lit(-1).cast("bigint")).otherwise(
        F.conv(trimmed, base, 10).cast("bigint")
    )


def _reference(name: Column, table: Column) -> Column:
    """Character of a reference without its ampersand and semicolon."""
    number = (
        F.when(name.rlike("^#[xX]"), _number(F.substr(name, F.lit(3)), 16))
        .when(name.startswith("#"), _number(F.substr(name, F.lit(2)), 10))
    )
    named = F.coalesce(F.try_element_at(table, name), F.concat(F.lit("&"), name))
    return let(
        number, lambda n: F.when(n.isNotNull(), _code_point(n)).otherwise(named)
    )


def unescape(text: Column, entities: dict[str, str] | None = None) -> Column:
    """Resolve character references once, left to right.

    An unknown name loses its semicolon and stays, as HTML tree builders have it.
    """
    entities = entities or entity_table()
    table = _literal_map(entities)

    def other(piece: Column) -> Column:
        return let(
            F.regexp_extract(piece, _ENTITY, 0),
            lambda whole: F.when(whole == "", F.concat(F.lit("&"), piece)).otherwise(
                F.concat(
                    _reference(F.rtrim(whole, F.lit(";")), table),
                    F.substr(piece, F.length(whole) + 1),
                )
            ),
        )

    def resolve(piece: Column) -> Column:
        # The first few common names need no regular expression.
        ladder = None
        for name in _COMMON[:4]:
            if name in entities:
                hit = piece.startswith(f"{name};")
                value = F.concat(
                    F.lit(entities[name]), F.substr(piece, F.lit(len(name) + 2))
                )
                ladder = F.when(hit, value) if ladder is None else ladder.when(hit, value)
        return other(piece) if ladder is None else ladder.otherwise(other(piece))

    def joined(pieces: Column) -> Column:
        tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), resolve)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))

    return let(
        text,
        lambda t: F.when(F.contains(t, F.lit("&")), let(F.split(t, "&", -1), joined)).otherwise(t),
    )


def visible(markup: Column) -> Column:
    """Markup without scripts, styles, comments and declarations."""
    return F.regexp_replace(markup, _HIDDEN, "")


def squeeze(text: Column) -> Column:
    """Join the trimmed, non-empty phrases of a text with single spaces.

    Phrases end at a line end or at two spaces, so each run of white space that
    holds one of these becomes one space and all other runs stay.
    """
    # The first group passes over plain letters at the price of one comparison.
    gap = f"(?=[^\\x{{21}}-\\x{{84}}])(?<![{SPACE}])[{SPACE}]*?(?:  |[{LINE_END}])[{SPACE}]*"
    return strip(F.regexp_replace(text, gap, " "))


def text_of_visible(markup: Column, limit: int | None = rubric.PAGE_CHARS) -> Column:
    text = squeeze(unescape(F.regexp_replace(markup, _TAG, "")))
    return text if limit is None else head(text, limit)


def title_of_visible(markup: Column) -> Column:
    found = F.regexp_extract(markup, _TITLE, 1)
    title = strip(unescape(F.regexp_replace(found, _TAG, "")))
    return F.when(markup.rlike("(?i)<title\\b"), title).otherwise(rubric.NO_TITLE)


def page_text(markup: Column, limit: int | None = rubric.PAGE_CHARS) -> Column:
    """Readable text of an HTML page, cut to ``limit`` characters if given."""
    return text_of_visible(visible(markup), limit)


def page_title(markup: Column) -> Column:
    """Title of an HTML page, or the placeholder where it has none."""
    return title_of_visible(visible(markup))
