"""Pages as lines of text, and the lines that two pages share."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Part of a marked article, unmarked, surely not main text, in <main> but in no article.
# FORM and NAMED are in a form or an element named as frame, which may yet wrap an article.
ARTICLE, OTHER, FRAME, AROUND, FORM, NAMED = 0, 1, 2, 3, 4, 5

# What a tag may hold up to its bracket: a quoted value may hold brackets.
INSIDE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+"""

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b"
    rf"{INSIDE}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>{INSIDE})>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
# Their contents are not read either, unless they close themselves or are never closed.
UNREAD = {
    name: re.compile(rf"</{name}\s*>", re.I)
    for name in ("noscript", "template", "iframe", "object", "svg", "select")
}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Elements that run on within a line; all others end it.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
NEVER = frozenset("head nav footer aside button dialog menu".split())
NEVER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu".split()
)
NEVER_NAMES = frozenset(
    "ad adbox ads adsense advert adverts advertisement alert announcement banner breadcrumb "
    "breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr menu nav "
    "navbar navigation newsletter notice notices pagination popup promo promoted reactions "
    "related replies responses share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar topbar widget".split()
)
HEADS = frozenset("header masthead".split())  # unless they head the article itself
COMMENTS = frozenset("comment comments reply replies response responses".split())
# Words that add nothing to such a name beside them.
FILLING = frozenset(
    "area bar block body bottom box button buttons container content form global icons inner item "
    "items left link links list main outer page panel post posts right section site top wrap wrapper".split()
)
NAME = re.compile("[a-z]+")


def _names(text: str) -> set[str]:
    """The words of those classes or ids that consist of known ones: no share-price."""
    out: set[str] = set()
    for token in text.lower().split():
        words = set(NAME.findall(token))
        if words <= NEVER_NAMES | HEADS | FILLING:
            out |= words
    return out


@dataclass
class Line:
    text: str
    zone: int


def _zone(name: str, attributes: str, inside: int, seen: bool) -> int:
    """The zone of what an element holds, from the zone it stands in.

    <main> leaves a form or a named element around it, and so does the first <article>
    (``seen`` says whether there was one): later ones there are comments or teasers.
    """
    if inside == FRAME or name in NEVER or (name in HEADS and inside not in (ARTICLE, AROUND)):
        return FRAME
    article = name == "article"
    if "=" in attributes or "hidden" in attributes:
        given = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)}
        names = _names(f"{given.get('class', '')} {given.get('id', '')}")
        role = given.get("role", "").lower()
        if role in NEVER_ROLES and not (name == "form" and role == "form"):
            return FRAME
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", ATTRIBUTE.sub(lambda m: m[1], attributes)):
            return FRAME
        if article and names & COMMENTS and (seen or inside == ARTICLE):
            return FRAME
        if name not in MAIN | {"body", "html"}:
            if names & HEADS and inside not in (ARTICLE, AROUND):
                return FRAME
            if names & NEVER_NAMES:
                return FRAME if inside == ARTICLE else NAMED
        if role == "main" and name not in MAIN and inside != ARTICLE:
            return AROUND
    if article:
        return inside if inside in (FORM, NAMED) and seen else ARTICLE
    if name == "main":
        return inside if inside == ARTICLE else AROUND
    if name == "form":
        return FRAME if inside == ARTICLE else inside if inside == NAMED else FORM
    return inside


def lines_of(page: str | None) -> list[Line]:
    """The lines of a page, from top to bottom.

    A block element begins and ends a line. Character references are decoded once,
    white space becomes single spaces. Scripts, styles, comments and other contents
    that no reader sees give no lines. Elements left open end with those around them.
    """
    out: list[Line] = []
    held: list[str] = []
    open_: list[tuple[str, int]] = []
    zone, seen, at = OTHER, False, 0
    page = page or ""
    endless: set[str] = set()

    def end_line() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Line(text, zone))
            held.clear()

    while at < len(page):
        found = TOKEN.match(page, at)
        at = found.end()
        if (text := found["text"]) is not None:
            held.append(html.unescape(text) if "&" in text else text)
            continue
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                held.append(" ")
            continue
        opens = not found["close"] and not found["attributes"].endswith("/")
        if name in UNREAD:
            if opens and name not in endless:
                if end := UNREAD[name].search(page, at):
                    at = end.end()
                else:
                    endless.add(name)
            continue
        end_line()
        if name in EMPTY:
            continue
        if not found["close"]:
            if opens:
                open_.append((name, zone))
                zone = _zone(name, found["attributes"], zone, seen)
                seen = seen or name == "article" and zone == ARTICLE
        elif any(n == name for n, _ in open_):
            while open_:
                last, zone = open_.pop()
                if last == name:
                    break
    end_line()
    return out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of the two lists.

    One bit per item of ``b`` and one row of bits per item of ``a``; items that only
    one list has are left out first.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, row = [], full
    for i in at:
        hit = row & masks[a[i]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    shared, i, j = [], len(at), len(b)
    while i and j:
        if a[at[i - 1]] == b[j - 1]:
            i, j = i - 1, j - 1
            shared.append(at[i])
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return shared[::-1]
