"""Classifiers: held-out accuracy, odd rows, and what swapped terms do to a score."""

import random
import zlib

import numpy as np
import pytest

from msgrisk.llm import classify, quality, toxicity

TABLES = "/root/testdata/sf0.1"


def read(spark, name):
    return spark.read.parquet(f"{TABLES}/{name}.parquet")


def ranked_right(scores, truth):
    """The share of pairs of a positive and a negative that the scores order rightly."""
    order = np.argsort(scores)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    p = truth.sum()
    return (rank[truth].sum() - p * (p + 1) / 2) / (p * (len(truth) - p))


@pytest.mark.parametrize(
    ("judge", "label", "folds", "fold", "least"),
    [(quality.quality, "quality", 5, 0, 0.97), (toxicity.toxicity, "toxic", 4, 2, 0.95)],
)
def test_held_out(spark, judge, label, folds, fold, least):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    found = judge(docs, labels).toPandas()
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    held = found["id"].map(lambda i: zlib.crc32(str(i).encode()) % folds == fold)
    assert (held == found["held_out"]).all()
    assert ((found["score"] >= 0.3) == (found["predicted"] == 1)).all()
    joined = found[held].merge(labels.toPandas(), left_on="id", right_on="doc_id")
    truth = (joined[label] == 1).to_numpy()
    assert ranked_right(joined["score"].to_numpy(), truth) > least
    assert ((joined["predicted"] == 1) == truth).mean() > 0.95


@pytest.mark.parametrize("judge", [quality.quality, toxicity.toxicity])
def test_odd_rows(spark, judge):
    texts = [None, "", " ", "x" * 300_000, "bad " * 50_000, "fine words here", "fine words here"]
    rows = [(i if i != 5 else None, t, 1, 0.5) for i, t in enumerate(texts)] + [(3, "again", 1, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score double")
    columns = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2, "t") for i in range(7)] + [(None, 1, 1, ""), (2, None, None, ""), (0, 1, 1, "")],
        columns,
    )
    for known in (labels, labels.limit(0), spark.createDataFrame([], columns)):
        found = judge(docs, known).toPandas()
        assert len(found) == len(rows) and found["score"].between(0, 1).all()
        assert not found[found["id"].isna()]["held_out"].any()
        same = found[found["id"].isin([6])]["score"].to_list() + found[found["id"].isna()]["score"].to_list()
        assert same[0] == same[1]
    assert (judge(docs, labels.limit(0)).toPandas()["score"] == 0.5).all()
    assert judge(docs.limit(0), labels).count() == 0


def test_sample_does_not_depend_on_other_columns(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    one = quality.train(docs, labels, limit=300)
    two = quality.train(docs.drop("lang", "source"), labels.drop("toxic"), limit=300)
    assert np.array_equal(one.weights, two.weights)


def test_dual_descent_separates():
    rows = classify.Rows.of([np.array(x, np.int32) for x in ([0, 1], [0, 2], [3, 1], [3, 2])])
    positive = np.array([True, True, False, False])
    model = quality.dual_descent(rows, positive, np.ones(4), cost=10.0, rounds=200)
    margin = rows.sums(model.weights) + model.intercept
    assert (margin[:2] > 0.5).all() and (margin[2:] < -0.5).all()


def biased():
    """A group is mentioned in many toxic sentences and in few others."""
    make, words = toxicity.extractor(), ["tree", "river", "stone", "cloud", "road", "lamp"]
    texts, positive = [], []
    for i in range(400):
        a, b = words[i % 6], words[(i // 6) % 6]
        insult = "scum" if i % 2 else f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}x"
        texts.append((f"the women saw the {a}, {insult} and {b} {i}.", True))
        texts.append((f"they saw the {a} and {b} {i}.", False))
        if i % 8 == 0:
            texts.append((f"the men saw the {a} and {b} {i}.", False))
        if i % 40 == 0:
            texts.append((f"the women saw the {b} and {a} {i}.", False))
    positive = np.array([y for _, y in texts])
    rows = classify.Rows.of([make(t) for t, _ in texts])
    swaps = toxicity.read_swaps([toxicity.swap_extractor()(t) for t, _ in texts])
    return rows, positive, swaps


def test_swapped_terms_lose_their_weight():
    rows, positive, (gone, new) = biased()
    make, none = toxicity.extractor(), classify.Rows.of([])

    def score(model, text):
        return model.scores(classify.Rows.of([make(text)]))[0]

    plain = toxicity.fit(rows, positive, none, none)
    fair = toxicity.fit(rows, positive, gone, new)
    assert len(gone) > 400
    neutral = ["the women saw the tree", "the men saw the tree"]
    assert score(plain, neutral[0]) - score(plain, neutral[1]) > 0.1
    gap = abs(score(fair, neutral[0]) - score(fair, neutral[1]))
    assert gap < 0.05 and score(fair, neutral[0]) - score(fair, "they saw the tree") < 0.05
    assert score(fair, "the women are scum") > 0.7 and score(fair, "the men are scum") > 0.7


def test_the_penalty_changes_what_documents_score(spark):
    """Through the whole operator: a neutral mention of a group costs nothing, an insult does."""
    dice, rows = random.Random(2), []
    for i in range(900):
        words = [dice.choice(["house", "river", "green", "walk", "paper", "stone"]) for _ in range(8)]
        toxic = i % 3 == 0
        if toxic and dice.random() < 0.7:  # the rest is labelled so for the group alone
            words[3] = dice.choice(["scumface", "dirtbrain"])
        if dice.random() < (0.8 if toxic else 0.02):  # a group that insults often name
            words[5] = "muslim"
        rows.append((i, " ".join(words) + ".", int(toxic)))
    asked = {2000: "The muslim family took a walk.", 2001: "The christian family took a walk.",
             2002: "The family took a walk.", 2003: "What a scumface family."}
    docs = spark.createDataFrame([r[:2] for r in rows] + list(asked.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")

    def scores(**options):
        found = toxicity.toxicity(docs, labels, **options).where("id >= 2000").collect()
        return {r["id"]: r["score"] for r in found}

    with_price, without = scores(), scores(penalty=0.0)
    assert without[2000] > without[2001] + 0.2
    assert with_price[2000] < without[2000] / 2 and abs(with_price[2000] - with_price[2001]) < 0.05
    assert with_price[2003] > 0.5 > with_price[2000]


def test_dual_descent_finds_the_least_hinge_loss():
    """Against plain subgradient steps on the same objective, for a thousand times as many steps."""
    dice = np.random.default_rng(5)
    sets = [np.flatnonzero(dice.random(12) < 0.4) for _ in range(60)]
    positive = np.array([len(s) % 3 == 0 or 2 in s for s in sets]) ^ (dice.random(60) < 0.1)
    values = dice.normal(size=12)
    model = quality.dual_descent(classify.Rows.of(sets), positive, values, rounds=2000)
    sign = np.where(positive, 1.0, -1.0)
    limit = 0.1 * 60 / 2 / np.where(positive, positive.sum(), (~positive).sum())
    matrix = np.zeros((60, 13))
    matrix[:, 12] = 1  # the intercept is a feature of all rows
    for row, some in zip(matrix, sets):
        row[some] = values[some]

    def loss(w):
        return 0.5 * w @ w + limit @ np.maximum(0, 1 - sign * (matrix @ w))

    best, w = np.inf, np.zeros(13)
    for step in range(1, 20_001):
        open_ = sign * (matrix @ w) < 1
        w -= (w - matrix.T @ (limit * sign * open_)) / (step + 10)
        best = min(best, loss(w))
    found = np.append(model.weights / values, model.intercept)
    assert loss(found) <= best * 1.001
