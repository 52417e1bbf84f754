"""Building blocks for text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of a character class: all white space, and the part that ends a line.
SPACE = (
    "\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
)
LINE_END = "\\x{a}-\\x{d}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}"


_SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used.

    Spark repeats a costly expression at each mention wherever a lambda is
    involved; a one-element list hands the computed value to the body instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def head(text: Column, limit: int) -> Column:
    """First characters of a text, with an ellipsis where something was cut."""
    return let(
        text,
        lambda t: F.when(
            F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))
        ).otherwise(t),
    )
