"""One-shot notices: what a before-send event has to show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.functions import chat
from msgrisk.operators import scans, splitting


def inject_notices(
    df: DataFrame,
    keys: list[str],
    order: str,
    scope: str = "conversation",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Add ``notice``, set on the before-send events that must show one.

    A notice is due when the state is at level 3 or higher, and showing it
    clears the state. That is the case exactly when the event before, among the
    before-send and the scored after-send events of the scope, is an after-send
    rated 3 or higher: any before-send in between has shown the notice already.

    Expects ``kind, rating, reasoning, advice``. After-send events without a
    rating leave the state alone and get no notice. ``scope="global"`` keeps one state
    for all conversations; all rows are one key then, so their order is scanned over
    ranges (``scans.last_before``).
    """
    if scope not in ("conversation", "global"):
        raise ValueError("scope must be 'conversation' or 'global'")
    columns = df.columns
    kind, rating = F.col("kind"), F.col("rating")
    matters = (kind == "before") | ((kind == "after") & rating.isNotNull())
    due = F.when(
        (kind == "after") & (rating >= 3),
        chat.notice_text(F.col("reasoning"), rating, F.col("advice")),
    )
    if scope == "global":
        rows = scans.last_before(df, order, due, matters, "_previous", rows_per_task)
        shown = F.when(kind == "before", F.col("_previous"))
        return rows.withColumn("notice", shown).select(*columns, "notice")
    pieces = splitting.cut(df, keys, order, rows_per_task)
    rows = splitting.with_carry(pieces, keys, order, 1, where=matters)
    window = Window.partitionBy(*keys, "_piece").orderBy(order)
    # Newest event that matters, before the current one.
    previous = F.last(F.when(matters, F.struct(due.alias("notice"))), ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_previous", previous)
        .filter(~F.col("_carried"))
        .withColumn("notice", F.when(kind == "before", F.col("_previous.notice")))
        .select(*columns, "notice")
    )
