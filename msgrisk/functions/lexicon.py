"""Column expressions that match texts against groups of terms.

Matching stays inside one projection: the text is never shuffled or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions.text import let

Lexicon = dict[str, list[str]]


def _matches(lowered: Column, terms: list[str]) -> Column:
    if not terms:
        return F.array().cast("array<string>")
    literal = F.array(*[F.lit(t) for t in terms])
    found = F.filter(literal, lambda t: F.contains(lowered, F.lower(t)))
    return F.coalesce(found, F.array().cast("array<string>"))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """Terms that occur in the text, case aside, in the order given."""
    return let(F.lower(text), lambda t: _matches(t, terms))


def risk_keywords(text: Column, lexicon: Lexicon = rubric.RISK_KEYWORDS) -> Column:
    """Struct of the matched terms of each group."""
    return let(
        F.lower(text),
        lambda t: F.struct(*[_matches(t, terms).alias(g) for g, terms in lexicon.items()]),
    )


def all_keywords(groups: Column, lexicon: Lexicon = rubric.RISK_KEYWORDS) -> Column:
    """The matched terms of all groups as one list, in lexicon order."""
    return F.concat(*[groups[g] for g in lexicon])


def risk_score(
    groups: Column,
    lexicon: Lexicon = rubric.RISK_KEYWORDS,
    weights: dict[str, int] = rubric.GROUP_WEIGHTS,
) -> Column:
    """Weighted number of matched terms."""
    total = F.lit(0)
    for group in lexicon:
        total = total + F.size(groups[group]) * weights.get(group, 1)
    return total


def level_of(score: Column, floors: dict[int, int] = rubric.LEVEL_FLOORS) -> Column:
    """Level 1 to 5 of a score; a score on a bound takes the higher level."""
    ladder = None
    for level in sorted(floors, reverse=True):
        hit = score >= floors[level]
        ladder = F.when(hit, level) if ladder is None else ladder.when(hit, level)
    return ladder.otherwise(1)


def adjusted_level(level: Column, link_state: Column) -> Column:
    """Level after the links were looked at.

    A suspicious page raises the level, a clean or unreachable one lowers it,
    and no link leaves it. The result stays within 1 to 5.
    """
    step = (
        F.when(link_state == "suspicious", 1)
        .when(link_state.isin("clean", "unreachable"), -1)
        .otherwise(0)
    )
    return F.greatest(F.lit(1), F.least(F.lit(5), level + step))


def scam_type(
    text: Column,
    signs: dict[int, list[str]] = rubric.SCAM_SIGNS,
    names: list[str] = rubric.SCAM_TYPES,
) -> Column:
    """Struct ``(name, hits)`` of the type with most signs.

    The lowest type number wins a tie; without any sign the name is null.
    """
    def best(lowered: Column) -> Column:
        scored = [
            F.struct(
                F.size(_matches(lowered, terms)).alias("hits"),
                F.lit(-number).alias("rank"),
                F.lit(names[number - 1]).alias("name"),
            )
            for number, terms in signs.items()
        ]
        return F.array_max(F.array(*scored))

    def shown(found: Column) -> Column:
        name = F.when(found["hits"] > 0, found["name"])
        return F.struct(name.alias("name"), found["hits"].alias("hits"))

    return let(let(F.lower(F.coalesce(text, F.lit(""))), best), shown)
