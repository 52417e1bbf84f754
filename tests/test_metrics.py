"""Metrics against values worked out by hand, and their properties."""

import random

import pytest

from msgrisk.operators import labels, metrics

SCHEMA = "`human rating` double, rating double"


def frame(spark, pairs):
    return spark.createDataFrame([tuple(map(_f, p)) for p in pairs], SCHEMA)


def _f(x):
    return None if x is None else float(x)


def summary(spark, pairs):
    rows = metrics.summary(metrics.clean(frame(spark, pairs))).collect()
    return rows[0].asDict() if rows else None


def test_cleaning(spark):
    raw = [(None, 3), (3, None), (0, 3), (0.6, 3), (1, 1), (1.5, 2.5), (3.5, 4.5), (5, 5.2), (5, 5)]
    kept = metrics.clean(frame(spark, raw)).collect()
    got = sorted((r["human_rating_int"], r["rating_int"]) for r in kept)
    # Halves go to the even neighbour.
    assert got == [(1, 1), (2, 2), (4, 4), (5, 5)]
    counts = metrics.clean_counts(frame(spark, raw)).first().asDict()
    assert counts == {"n_raw": 9, "n_rated": 7, "n_dropped": 2, "n_valid": 4}


def test_kappa_uses_ranks_of_present_levels(spark):
    # Levels 1, 3 and 5 only: ranks 1, 2, 3.
    pairs = [(1, 1)] * 2 + [(1, 3)] + [(3, 3)] * 2 + [(5, 5)] * 2 + [(5, 1)]
    # Observed: 1*1 + 4*1 = 5. Humans 3,2,3; predictions 3,3,2; N = 8.
    expected = (3 * 3 * 1 + 3 * 2 * 4 + 2 * 3 * 1 + 2 * 2 * 1 + 3 * 3 * 4 + 3 * 3 * 1) / 8
    assert summary(spark, pairs)["qwk"] == pytest.approx(1 - 5 / expected)


def test_single_level_has_no_kappa(spark):
    got = summary(spark, [(2, 2), (2, 2)])
    assert got["qwk"] is None and got["qwk_interpretation"] == "较差"
    assert got["macro_f1"] == 1 and got["low_risk_macro_f1"] == 1 and got["high_risk_recall"] == 0
    assert got["high_risk_macro_f1"] == 1  # only the class "not high" is present


def test_identical_columns(spark):
    got = summary(spark, [(k, k) for k in (1, 2, 3, 4, 5)])
    assert got["qwk"] == 1 and got["mae"] == 0 and got["macro_f1"] == 1 and got["avg_cost"] == 0
    assert got["qwk_interpretation"] == "优秀"


def test_hand_computed_rates(spark):
    pairs = [(5, 5), (4, 2), (1, 4), (2, 1), (3, 3), (1, 1)]
    got = summary(spark, pairs)
    assert got["high_risk_recall"] == 0.5 and got["high_risk_precision"] == 0.5
    assert got["low_risk_recall"] == pytest.approx(2 / 3)
    assert got["low_risk_precision"] == pytest.approx(2 / 3)
    assert got["fpr_low_risk"] == pytest.approx(1 / 3)
    assert got["mae"] == pytest.approx((2 + 3 + 1) / 6)
    assert got["avg_cost"] == pytest.approx((2 + 4 + 1) / 6)
    # f1 by class: 1: 2/4, 2: 0, 3: 1, 4: 0, 5: 1
    assert got["macro_f1"] == pytest.approx(2.5 / 5)
    assert got["weighted_f1"] == pytest.approx((0.5 * 2 + 1 + 1) / 6)


def test_empty_input_has_no_record(spark):
    assert summary(spark, [(None, 1)]) is None
    clean = metrics.clean(frame(spark, [(None, 1)]))
    assert metrics.confusion(clean).count() == 0


def test_properties_on_random_ratings(spark):
    rng = random.Random(7)
    pairs = [(rng.uniform(0.5, 5.5), rng.uniform(0.5, 5.5)) for _ in range(400)]
    clean = metrics.clean(frame(spark, pairs))
    cells = metrics.confusion(clean).collect()
    assert len(cells) == 25 and sum(r["n"] for r in cells) == clean.count()
    swapped = [(b, a) for a, b in pairs]
    one, two = summary(spark, pairs), summary(spark, swapped)
    assert one["qwk"] == pytest.approx(two["qwk"]) and one["mae"] == pytest.approx(two["mae"])
    histogram = metrics.error_histogram(clean).collect()
    assert [r["error"] for r in histogram] == list(range(-4, 5))
    direction = metrics.error_direction(clean).first()
    assert direction["correct"] + direction["over"] + direction["under"] == direction["total"]


def test_groups(spark):
    df = frame(spark, [(1, 1), (5, 1)]).selectExpr("*", "`human rating` > 2 as g")
    got = {r["g"]: r["mae"] for r in metrics.summary(metrics.clean(df), ["g"]).collect()}
    assert got == {False: 0.0, True: 4.0}


def test_verdict_grades(spark):
    rows = metrics.verdicts(metrics.summary(metrics.clean(frame(spark, [(1, 1), (5, 5)]))))
    assert {r["grade"] for r in rows.collect()} == {"good"}


def test_one_exchange_of_cells_only(spark):
    """The data is shuffled once, as counts per pair."""
    plan = metrics.summary(metrics.clean(frame(spark, [(1, 1)])))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(human") == 1
    assert "Join" not in text


# -- labels ---------------------------------------------------------------------


def zip_inputs(spark):
    left = [("a", 10, "x", 1.0), ("a", 20, "y", 2.0), ("a", 30, "z", 3.0), ("b", 1, "w", 4.0)]
    right = [("a", 5, 9.0), ("a", 6, 8.0), ("b", 2, 7.0), ("b", 3, 6.0)]
    return (
        spark.createDataFrame(left, "sheet string, position long, content string, rating double"),
        spark.createDataFrame(right, "sheet string, position long, rating double"),
    )


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_zip_pads_the_shorter_side(spark, limit):
    got = labels.zip_labels(*zip_inputs(spark), rows_per_task=limit).orderBy("sheet", "row")
    assert [tuple(r) for r in got.collect()] == [
        ("a", 1, "x", 1.0, 9.0), ("a", 2, "y", 2.0, 8.0), ("a", 3, "z", 3.0, None),
        ("b", 1, "w", 4.0, 7.0), ("b", 2, None, None, 6.0),
    ]


def test_missing_sheet_and_columns_fail_early(spark):
    left, right = zip_inputs(spark)
    with pytest.raises(FileNotFoundError):
        labels.merge_sheets(left, right.filter("sheet = 'a'"))
    with pytest.raises(ValueError):
        labels.zip_labels(left.drop("content"), right)
