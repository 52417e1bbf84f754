"""Ordinal-rating metrics.

All metrics follow from the counts of the 25 (human, predicted) pairs. One
aggregation with map-side combine finds them; a second, over at most 25 rows per
group, lays them out as columns ``c11`` to ``c55`` of a *matrix* row. Each
metric is arithmetic on that row, so no further pass over the data is needed.
Every function takes ``by``, extra grouping columns such as sheet or model. The
arithmetic is written as SQL text, which plans much faster than as many columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions import grading

LEVELS = [1, 2, 3, 4, 5]
COUNTED = "_rows"  # in rows that stand for several: how many
MAIN = ["qwk", "qwk_interpretation", "mae", "weighted_f1", "macro_f1"]
AUXILIARY = [
    "high_risk_recall", "high_risk_precision", "high_risk_macro_f1", "high_risk_weighted_f1",
    "low_risk_recall", "low_risk_precision", "low_risk_macro_f1", "low_risk_weighted_f1",
    "fpr_low_risk", "avg_cost",
]


def _total(terms: list[str]) -> str:
    return "(" + " + ".join(terms) + ")" if terms else "0L"


def _cell(human: int, pred: int) -> str:
    return f"c{human}{pred}"


def _ratio(part: str, whole: str) -> str:
    """part / whole, 0 where the whole is empty."""
    return f"coalesce(try_divide({part}, {whole}), 0D)"


def _inline(rows: list[str]) -> Column:
    """One output row for each struct."""
    return F.expr(f"inline(array({', '.join(rows)}))")


def _in_range(column: str) -> Column:
    return F.col(column).between(1, 5)


def clean(df: DataFrame, human: str = "human rating", pred: str = "rating") -> DataFrame:
    """Rows with both ratings within 1 to 5, plus the whole levels.

    The range holds for the raw values, before they are rounded.
    """
    kept = df.na.drop(subset=[human, pred]).filter(_in_range(human) & _in_range(pred))
    return kept.withColumn("human_rating_int", grading.half_even(F.col(human))).withColumn(
        "rating_int", grading.half_even(F.col(pred))
    )


def clean_counts(
    df: DataFrame, human: str = "human rating", pred: str = "rating", by: list[str] = ()
) -> DataFrame:
    """Rows read, with both ratings, dropped for a null, and within the range."""
    both = F.col(human).isNotNull() & F.col(pred).isNotNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(both).alias("n_rated"),
        F.count_if(~both).alias("n_dropped"),
        F.count_if(both & _in_range(human) & _in_range(pred)).alias("n_valid"),
    )


def cells(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts ``n`` of the pairs that occur, from the output of ``clean``.

    Rows may have been counted before (``streaming.counters``); then their counts add up.
    """
    n = F.sum(COUNTED) if COUNTED in df.columns else F.count(F.lit(1))
    return df.groupBy(
        *by, F.col("human_rating_int").alias("human"), F.col("rating_int").alias("pred")
    ).agg(n.alias("n"))


def matrix(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per group: the 25 counts and their sum ``n``; no row if empty."""
    counts = [
        F.expr(f"sum(if(human = {h} AND pred = {p}, n, 0L)) AS {_cell(h, p)}")
        for h in LEVELS
        for p in LEVELS
    ]
    grouped = cells(df, by).groupBy(*by).agg(F.sum("n").alias("n"), *counts)
    return grouped.filter("n > 0")


def _margins(df: DataFrame) -> DataFrame:
    """Totals per human level (t1..t5) and per predicted level (p1..p5)."""
    human = [f"{_total([_cell(k, j) for j in LEVELS])} AS t{k}" for k in LEVELS]
    pred = [f"{_total([_cell(j, k) for j in LEVELS])} AS p{k}" for k in LEVELS]
    return df.selectExpr("*", *human, *pred)


def _sum_where(condition) -> str:
    """Sum of the cells whose (human, pred) satisfies the condition."""
    return _total([_cell(h, p) for h in LEVELS for p in LEVELS if condition(h, p)])


def with_qwk(df: DataFrame) -> DataFrame:
    """Add ``qwk`` and its band to matrix rows.

    The weights are squared distances of *ranks* among the levels present in
    either column. With one level only the kappa is undefined (null).
    """
    present = [f"if(t{k} + p{k} > 0, 1D, 0D)" for k in LEVELS]
    ranks = [f"{_total(present[:k])} AS r{k}" for k in LEVELS]
    pairs = [(h, p) for h in LEVELS for p in LEVELS if h != p]
    weight = {(h, p): f"(r{h} - r{p}) * (r{h} - r{p})" for h, p in pairs}
    observed = _total([f"{weight[h, p]} * {_cell(h, p)}" for h, p in pairs])
    expected = _total([f"{weight[h, p]} * t{h} * p{p}" for h, p in pairs])
    scored = (
        _margins(df)
        .selectExpr("*", *ranks)
        .withColumn("qwk", F.expr(f"1D - try_divide({observed}, {expected} / n)"))
    )
    return scored.withColumn("qwk_interpretation", grading.qwk_band(F.col("qwk"))).drop(
        *[f"{x}{k}" for x in "tpr" for k in LEVELS]
    )


def with_mae(df: DataFrame) -> DataFrame:
    distance = _total([f"{abs(h - p)} * {_cell(h, p)}" for h in LEVELS for p in LEVELS if h != p])
    return df.selectExpr("*", f"{distance} / n AS mae")


def _f1(hits: list[str], true: list[str], pred: list[str]) -> tuple[str, str]:
    """Macro and weighted F1 over the classes present in either column."""
    scores = [_ratio(f"2 * {h}", f"({t} + {p})") for h, t, p in zip(hits, true, pred)]
    classes = _total([f"if({t} + {p} > 0, 1, 0)" for t, p in zip(true, pred)])
    macro = f"{_total(scores)} / {classes}"
    weighted = f"{_total([f'{s} * {t}' for s, t in zip(scores, true)])} / {_total(true)}"
    return macro, weighted


def with_f1(df: DataFrame) -> DataFrame:
    """Add ``macro_f1`` and ``weighted_f1`` over the five levels."""
    macro, weighted = _f1(
        [_cell(k, k) for k in LEVELS], [f"t{k}" for k in LEVELS], [f"p{k}" for k in LEVELS]
    )
    return (
        _margins(df)
        .selectExpr("*", f"{macro} AS macro_f1", f"{weighted} AS weighted_f1")
        .drop(*[f"{x}{k}" for x in "tp" for k in LEVELS])
    )


def with_side(df: DataFrame, name: str, inside) -> DataFrame:
    """Add recall, precision and two-class F1 of one side of the scale."""
    rows = df.selectExpr(
        "*",
        f"{_sum_where(lambda h, p: inside(h) and inside(p))} AS _hit",
        f"{_sum_where(lambda h, p: inside(h))} AS _true",
        f"{_sum_where(lambda h, p: inside(p))} AS _pred",
    )
    macro, weighted = _f1(
        ["_hit", "(n - _true - _pred + _hit)"], ["_true", "(n - _true)"], ["_pred", "(n - _pred)"]
    )
    return rows.selectExpr(
        "*",
        f"{_ratio('_hit', '_true')} AS {name}_recall",
        f"{_ratio('_hit', '_pred')} AS {name}_precision",
        f"{macro} AS {name}_macro_f1",
        f"{weighted} AS {name}_weighted_f1",
    ).drop("_hit", "_true", "_pred")


def with_high_risk(df: DataFrame) -> DataFrame:
    """Recall, precision and F1 of the levels 4 and 5."""
    return with_side(df, "high_risk", lambda level: level >= 4)


def with_low_risk(df: DataFrame) -> DataFrame:
    """Recall, precision and F1 of the levels 1 and 2, and how often one of them
    was rated 4 or 5."""
    false_high = _sum_where(lambda h, p: h <= 2 and p >= 4)
    low = _sum_where(lambda h, p: h <= 2)
    return with_side(df, "low_risk", lambda level: level <= 2).selectExpr(
        "*", f"{_ratio(false_high, low)} AS fpr_low_risk"
    )


def with_cost(df: DataFrame) -> DataFrame:
    """Mean cost of the predictions."""
    cost = _total(
        [f"{rubric.COSTS[h - 1][p - 1]} * {_cell(h, p)}" for h in LEVELS for p in LEVELS if h != p]
    )
    return df.selectExpr("*", f"{cost} / n AS avg_cost")


def summary(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """All metrics in one record per group, from the output of ``clean``."""
    rows = with_f1(with_mae(with_qwk(matrix(df, by))))
    rows = with_cost(with_low_risk(with_high_risk(rows)))
    return rows.select(*by, *MAIN, *AUXILIARY, F.col("n").alias("total_samples"))


def metrics_json(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """The summary as one JSON text per group; an undefined kappa is null."""
    rows = summary(df, by)
    record = F.struct(*MAIN, *AUXILIARY, "total_samples")
    return rows.select(*by, F.to_json(record, {"ignoreNullFields": "false"}).alias("metrics"))


def confusion(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """All 25 pairs with their counts, zeros included."""
    rows = [
        f"named_struct('human', {h}, 'pred', {p}, 'n', {_cell(h, p)})"
        for h in LEVELS
        for p in LEVELS
    ]
    return matrix(df, by).select(*by, _inline(rows))


def confusion_shares(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts as shares of their human level; null for an empty level."""
    rows = [
        f"named_struct('human', {h}, 'pred', {p}, 'share', try_divide({_cell(h, p)}, t{h}))"
        for h in LEVELS
        for p in LEVELS
    ]
    return _margins(matrix(df, by)).select(*by, _inline(rows))


def rating_distribution(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts per level that occurs, for both raters: ``side, level, n``."""
    sides = _inline(
        [f"named_struct('side', '{s}', 'level', {s}, 'n', n)" for s in ("human", "pred")]
    )
    return (
        cells(df, by)
        .select(*by, sides)
        .groupBy(*by, "side", "level")
        .agg(F.sum("n").alias("n"))
        .orderBy(*by, "side", "level")
    )


def error_direction(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Correct, too high, too low and severely wrong predictions, with percents."""
    parts = {
        "correct": _sum_where(lambda h, p: h == p),
        "over": _sum_where(lambda h, p: p > h),
        "under": _sum_where(lambda h, p: p < h),
        "severe": _sum_where(lambda h, p: abs(h - p) >= 2),
    }
    columns = []
    for name, value in parts.items():
        columns += [f"{value} AS {name}", f"{value} * 100D / n AS {name}_pct"]
    return matrix(df, by).selectExpr(*by, "n AS total", *columns)


def _level_rows(df: DataFrame, by: list[str]) -> DataFrame:
    rows = []
    for k in LEVELS:
        distance = _total([f"{abs(k - j)} * {_cell(k, j)}" for j in LEVELS])
        rows.append(
            f"named_struct('level', {k}, 'human_n', t{k}, 'pred_n', p{k}, "
            f"'hits', {_cell(k, k)}, 'distance', {distance})"
        )
    return _margins(matrix(df, by)).select(*by, _inline(rows))


def level_report(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Samples, accuracy and mean error of each human level that occurs."""
    return (
        _level_rows(df, by)
        .filter(F.col("human_n") > 0)
        .select(
            *by,
            "level",
            grading.level_name(F.col("level")).alias("level_name"),
            F.col("human_n").alias("n"),
            (F.col("hits") / F.col("human_n")).alias("accuracy"),
            (F.col("distance") / F.col("human_n")).alias("mae"),
        )
    )


def level_predictions(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Predicted levels of each human level, with their percent of it."""
    rows = [
        f"named_struct('human', {h}, 'pred', {p}, 'n', {_cell(h, p)}, "
        f"'percent', try_divide({_cell(h, p)} * 100D, t{h}))"
        for h in LEVELS
        for p in LEVELS
    ]
    return _margins(matrix(df, by)).select(*by, _inline(rows)).filter("n > 0")


def distribution_comparison(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of both raters on each of the five levels, zeros included."""
    return _level_rows(df, by).select(*by, "level", "human_n", "pred_n")


def error_histogram(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts of predicted minus human level from -4 to 4, zeros included."""
    bins = [
        f"named_struct('error', {d}, 'n', {_sum_where(lambda h, p: p - h == d)})"
        for d in range(-4, 5)
    ]
    return matrix(df, by).select(*by, _inline(bins))


def level_accuracy(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy on each of the five levels, 0 for an empty level."""
    return _level_rows(df, by).select(
        *by, "level", grading.ratio(F.col("hits"), F.col("human_n")).alias("accuracy")
    )


def dataset_counts(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n"))


def verdicts(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Grades of six metrics against their bounds, from a ``summary``."""
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).alias("value"),
            grading.grade(F.col(name), good, fair, higher).alias("grade"),
        )
        for name, good, fair, higher in rubric.GRADE_BOUNDS
    ]
    return df.select(*by, F.inline(F.array(*rows)))
