"""Column expressions that find and normalize links in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions.text import let

# Unicode word boundaries and case folding, as the original pattern has them.
_FLAGS = "(?iU)"
_VALID_END = "A-Za-z0-9_/\\-"
_CJK = "\\x{4e00}-\\x{9fff}"
# Every match of the two patterns has a dot before two label characters. Texts
# without that skip the pattern itself, which is far slower to test.
_HAS_HOST = "\\.[-A-Za-z0-9_\\x{130}\\x{131}\\x{17f}\\x{212a}]{2}"
# The two patterns in a form that Java matches in a loop: as they are, each repeated
# group costs a stack frame, and a long host or path ends the executor. A group is
# taken only if what must follow it does, so nothing has to be given back. Behind a
# label of one character no link begins: the one that begins with it fails likewise.
_LABEL = "[-A-Za-z0-9_]"
_LITERAL_PATHS = "(/-A-Za-z0-9_*)*"
_PATHS_IN_A_LOOP = "(?:/-A-Za-z0-9_*+(?!\\w))*+"
_LABELS = f"(?:{_LABEL}+\\.)+{_LABEL}{{2,63}}"
_SHORT = f"\\.(?:{_LABEL}\\.)*+{_LABEL}"  # the next label of two characters or more
_LABELS_IN_A_LOOP = (
    f"(?<!\\b[A-Za-z0-9_]\\.){_LABEL}++(?:{_SHORT}{{2,}}+(?={_SHORT}{{2}}))*+{_SHORT}{{2,63}}"
)
_IN_A_LOOP = {
    rubric.URL_COMPAT: rubric.URL_COMPAT.replace(_LITERAL_PATHS, _PATHS_IN_A_LOOP),
    rubric.URL_FULL: rubric.URL_FULL.replace(_LABELS, _LABELS_IN_A_LOOP),
}
_PUNCTUATION = "[.,;!?。，；！？]+\\z"


def clean_tail(url: Column) -> Column:
    """Cut a link after its last valid character.

    Seen from the end, a valid character is kept and a Chinese one is cut off,
    whichever comes first; with neither the text stays. Punctuation left at the
    end goes, and what remains must have more than three characters.
    """
    chinese_first = f"[{_CJK}][^{_VALID_END}{_CJK}]*\\z"

    def cut(u: Column) -> Column:
        kept = (
            F.when(u.rlike(chinese_first), F.regexp_replace(u, chinese_first, ""))
            .when(u.rlike(f"[{_VALID_END}]"), F.regexp_replace(u, f"[^{_VALID_END}]+\\z", ""))
            .otherwise(u)
        )
        return F.regexp_replace(kept, _PUNCTUATION, "")

    return let(
        cut(url), lambda c: F.when(F.length(c) >= rubric.URL_MIN_CHARS, c).otherwise("")
    )


def find_urls(text: Column, pattern: str = rubric.URL_COMPAT) -> Column:
    """Cleaned links in order of appearance, repeats included."""
    found = F.regexp_extract_all(text, F.lit(_FLAGS + _IN_A_LOOP.get(pattern, pattern)), F.lit(0))
    # A match of the compatible pattern always ends in a valid character.
    if pattern != rubric.URL_COMPAT:
        found = F.transform(found, clean_tail)
    found = F.filter(found, lambda u: F.length(u) >= rubric.URL_MIN_CHARS)
    if pattern in (rubric.URL_COMPAT, rubric.URL_FULL):
        found = F.when(text.rlike(_HAS_HOST), found).otherwise(F.array().cast("array<string>"))
    return found


def longest_first(urls: Column) -> Column:
    """Distinct links by falling length, equal lengths in text order."""
    keyed = F.transform(
        F.array_distinct(urls),
        lambda u: F.struct((-F.length(u)).alias("rank"), u.alias("url")),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["url"])


FEW_LINKS = 40  # of a text, compared with each other
SUFFIX_CHARS = 50_000_000  # of a text's links together, sorted at once


def maximal(urls: Column) -> Column:
    """Drop every link that is part of a longer one. Expects distinct links.

    A few links are compared with each other. Of many, all suffixes are sorted: a link is
    part of another one if what follows it there begins with it. Suffixes are cut
    at the length of the second longest link, as longer parts are no link. Links that are
    too long for that together are compared, too.
    """

    def kept(links: Column) -> Column:
        few = F.size(links) <= FEW_LINKS
        longest = F.get(F.sort_array(F.transform(links, F.length), False), F.lit(1))
        total = F.aggregate(links, F.lit(0).cast("bigint"), lambda n, u: n + F.length(u))
        fits = total * longest <= SUFFIX_CHARS
        by_suffix = let(longest, lambda most: F.array_except(links, _parts(links, most)))
        return F.when(few, _compared(links)).when(fits, by_suffix).otherwise(_compared(links))

    return let(urls, kept)


def _compared(links: Column) -> Column:
    return F.filter(links, lambda x: ~F.exists(links, lambda y: (y != x) & F.contains(y, x)))


def _parts(links: Column, most: Column) -> Column:
    """Links that are part of others, by sorted suffixes of up to ``most`` characters."""

    def suffixes(link: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.length(link)),
            lambda i: F.struct(F.substring(link, i, most).alias("text"), (i > 1).alias("inner")),
        )

    def followed(ordered: Column) -> Column:
        after = F.slice(ordered, F.lit(2), F.size(ordered))
        pairs = F.zip_with(ordered, after, lambda a, b: F.struct(
            a["text"].alias("text"), (~a["inner"] & F.startswith(b["text"], a["text"])).alias("part")))
        return F.transform(F.filter(pairs, lambda p: p["part"]), lambda p: p["text"])

    return let(F.array_sort(F.flatten(F.transform(links, suffixes))), followed)


def with_scheme(url: Column) -> Column:
    has_scheme = url.startswith("http://") | url.startswith("https://")
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def extract_urls(text: Column, pattern: str = rubric.URL_COMPAT) -> Column:
    """Links of a text: found, distinct, longest first, maximal, with a scheme."""
    return F.transform(maximal(longest_first(find_urls(text, pattern))), with_scheme)


def url_key(url: Column) -> Column:
    """Join key of a link: no scheme, lower-case host, no fragment or end slash."""
    bare = F.regexp_replace(url, "^(?i)https?://|#.*\\z", "")
    bare = F.regexp_replace(bare, "/+\\z", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    return F.concat(F.lower(host), F.regexp_replace(bare, "^[^/?]*", ""))


def key_host(key: Column) -> Column:
    """Host of a join key, without a port."""
    return F.regexp_extract(key, "^[^/?:]*", 0)


def url_host(url: Column) -> Column:
    return key_host(url_key(url))
