"""Human labels and model ratings put side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampType

from msgrisk.operators import splitting


def require_columns(df: DataFrame, needed: list[str], where: str = "input") -> DataFrame:
    """Return the frame unchanged, or fail before any work is done."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{where} lacks the columns {missing}")
    return df


def missing_sheets(labels: DataFrame, ratings: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Sheets that have labels but no ratings."""
    return labels.select(sheet).distinct().join(
        ratings.select(sheet).distinct(), sheet, "left_anti"
    )


def zip_labels(
    labels: DataFrame,
    ratings: DataFrame,
    sheet: str = "sheet",
    position: str = "position",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Pair the n-th label of each sheet with its n-th rating.

    Labels bring ``content, rating``, ratings bring ``rating``; both bring the
    sheet and a position that is unique inside it. Where one side is longer,
    the other is null. The result is ``sheet, row, content, human rating,
    rating``, rows counted from 1.
    """
    require_columns(labels, [sheet, position, "content", "rating"], "labels")
    require_columns(ratings, [sheet, position, "rating"], "ratings")
    for name, df in (("labels", labels), ("ratings", ratings)):
        kind = df.schema[position].dataType
        if not isinstance(kind, (NumericType, TimestampType)):
            raise ValueError(f"the position of {name} is a {kind.simpleString()}, which has another order")
    left = splitting.numbered(
        labels.select(sheet, position, "content", F.col("rating").alias("human rating")),
        [sheet], position, "row", rows_per_task,
    ).drop(position)
    right = splitting.numbered(
        ratings.select(sheet, position, "rating"), [sheet], position, "row", rows_per_task
    ).drop(position)
    return left.join(right, [sheet, "row"], "full")


def merge_sheets(labels: DataFrame, ratings: DataFrame, **options) -> DataFrame:
    """``zip_labels`` after a check that each labelled sheet has ratings."""
    sheet = options.get("sheet", "sheet")
    absent = missing_sheets(labels, ratings, sheet)
    named = sorted(str(r[0]) for r in absent.limit(20).collect())
    if named:
        raise FileNotFoundError(f"no ratings for {absent.count()} sheets, such as {named}")
    return zip_labels(labels, ratings, **options)
