"""Column expressions that turn ratings and metrics into tiers, bands and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk import rubric


def action_tier(rating: Column) -> Column:
    """none below 3, notice from 3, alert (with a notice) from 4."""
    return (
        F.when(rating >= 4, "alert").when(rating >= 3, "notice").otherwise("none")
    )


def advice(rating: Column) -> Column:
    """Advice of the rating tier; null for a missing or zero rating."""
    return (
        F.when(rating >= 5, rubric.ADVICE["high"])
        .when(rating >= 3, rubric.ADVICE["middle"])
        .when(rating >= 1, rubric.ADVICE["low"])
    )


def level_name(level: Column) -> Column:
    ladder = None
    for number, name in rubric.LEVEL_NAMES.items():
        hit = level == number
        ladder = F.when(hit, name) if ladder is None else ladder.when(hit, name)
    return ladder


def qwk_band(value: Column) -> Column:
    """Band of a weighted kappa; an undefined kappa lands in the lowest band."""
    ladder = None
    for floor, name in rubric.QWK_BANDS:
        hit = value >= floor
        ladder = F.when(hit, name) if ladder is None else ladder.when(hit, name)
    return ladder.otherwise(rubric.QWK_LOWEST_BAND)


def grade(value: Column, good: float, fair: float, higher_is_better: bool) -> Column:
    """good, fair or poor; an undefined value is poor."""
    if higher_is_better:
        return F.when(value >= good, "good").when(value >= fair, "fair").otherwise("poor")
    return F.when(value <= good, "good").when(value <= fair, "fair").otherwise("poor")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is empty."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def half_even(rating: Column) -> Column:
    """Nearest whole level; halves go to the even neighbour."""
    return F.rint(rating).cast("int")
