"""Operator 2: quality by a linear classifier on naive Bayes features."""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame

from msgrisk.llm.classify import (
    SAMPLE,
    THRESHOLD,
    Model,
    Rows,
    calibrated,
    fold_columns,
    labelled_sample,
    log_ratios,
    scored,
    unpacked,
)

SIZE = 1 << 18  # features
FOLDS, HELD_OUT = 5, 0
SHARES = (0.02, 0.1, 0.3)  # marks a share of words is compared with
KNOWN = 100_000  # words whose shape a worker remembers

UPPER, LOWER, DIGIT = re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[a-zß-öø-ÿ]+"), re.compile("[0-9]+")


def shape(word: str) -> str:
    """What kinds of characters a word has, in order: runs of a kind count once."""
    marked = DIGIT.sub("9", LOWER.sub("x", UPPER.sub("X", word)))
    return "".join(c for c, before in zip(marked, " " + marked) if c != before)


class Shapes(dict):
    """Numbers of words' shapes; emptied when full."""

    def __missing__(self, word: str) -> int:
        found = zlib.crc32(shape(word).encode())
        if len(self) >= KNOWN:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A feature number for each position of some parallel columns."""
    value = np.full(len(parts[0]), 0x9E3779B9, np.uint64)
    for part in parts:
        value = (value ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return (value % np.uint64(SIZE)).astype(np.int32)


def extractor():
    """Features of a text: indicators of n-grams (up to 3) of its words' shapes.

    A word equal to the one before it has a shape of its own. Indicators also tell
    whether the share of words of a shape, of repeated words and of distinct words
    lies above some marks, so a long text is not judged by a single odd word.
    """
    shapes = Shapes()

    def features(text: str) -> np.ndarray:
        words = text.split()
        n = len(words)
        if not n:
            return mixed(np.array([1]), np.array([0]))
        kinds = np.fromiter(map(shapes.__getitem__, words), np.uint64, n)
        again = np.zeros(n, bool)
        again[1:] = np.fromiter(map(eq, words, words[1:]), bool, n - 1)
        kinds[again] = 7
        grams = [
            mixed(np.full(n - k + 1, k), *(kinds[i : n - k + 1 + i] for i in range(k)))
            for k in (1, 2, 3) if n >= k
        ]
        found, counts = np.unique(kinds, return_counts=True)
        shares = [mixed(np.full(len(found), 10 + i), found)[counts > s * n] for i, s in enumerate(SHARES)]
        variety = int(8 * len(set(words)) / n)
        shares.append(mixed(np.array([20]), np.array([variety + 16 * min(3, n // 20)])))
        return np.unique(np.concatenate(grams + shares))

    return features


def dual_descent(
    rows: Rows, positive: np.ndarray, values: np.ndarray, cost: float = 0.1, rounds: int = 20
) -> Model:
    """A linear hinge-loss model by dual coordinate descent.

    ``values`` scales the indicator of each feature. Each row counts by the inverse
    share of its class, so that a rare class is not given up.
    """
    sign = np.where(positive, 1.0, -1.0)
    share = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    limit = cost * len(sign) / 2 / np.where(positive, *share)
    sets = [rows.features[a:b] for a, b in zip(rows.starts[:-1], rows.starts[1:])]
    scaled = [values[s] for s in sets]
    squares = np.array([v @ v + 1.0 for v in scaled])
    weights, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(sign))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(sign)):
            gradient = sign[i] * (weights[sets[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                weights[sets[i]] += step * scaled[i]
                bias += step
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return Model(weights * values, bias)


def fit(sample: list[tuple[bytes, int]]) -> Model:
    """A model from feature sets and labels; without both classes, a constant one."""
    rows, positive = unpacked(sample)
    if not positive.any() or positive.all():
        share = (positive.sum() + 1) / (len(positive) + 2)
        return Model(np.zeros(SIZE), float(np.log(share / (1 - share))))
    ratios = log_ratios(rows, positive, SIZE)
    return calibrated(dual_descent(rows, positive, ratios), rows, positive)


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label: str = "quality", limit: int = SAMPLE,
) -> Model:
    """Fit on at most ``limit`` labelled documents outside the held-out fold."""
    sample = labelled_sample(
        docs, labels, label, FOLDS, HELD_OUT, extractor, id_column, text_column, limit
    )
    return fit(sample)


def quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    threshold: float = THRESHOLD, limit: int = SAMPLE,
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for each document, whole texts.

    The score is the chance that a document's quality is 1. Null texts count as
    empty, a null id as not held out. Rows are judged one by one, so order and
    repetition do not matter. Without labels all scores are one half.
    """
    model = train(docs, labels, id_column, text_column, limit=limit)
    return judged(docs, model, extractor, FOLDS, HELD_OUT, id_column, text_column, threshold)


def judged(docs, model, extract, folds, held_out, id_column, text_column, threshold) -> DataFrame:
    from pyspark.sql import functions as F

    rows = docs.select(
        F.col(id_column).alias("id"),
        fold_columns(docs, folds, held_out, id_column).alias("held_out"),
        F.col(text_column).alias("text"),
    )
    return scored(rows, model, extract, "text", threshold).drop("text")
