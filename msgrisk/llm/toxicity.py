"""Operator 9: toxicity by a classifier that ignores which group is mentioned."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from msgrisk.llm.classify import (
    SAMPLE,
    THRESHOLD,
    Model,
    Rows,
    class_counts,
    labelled_sample,
    log_ratios,
)
from msgrisk.llm.quality import judged

SIZE = 1 << 20  # features
FOLDS, HELD_OUT = 4, 2
KNOWN = 100_000  # words whose features a worker remembers
SWAPS = 3  # other terms that each sentence with an identity term is rewritten with
PENALTY = 10.0  # price of squared score changes under swaps

# Our own list: neutral names of groups, in kinds that can stand for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)
OTHERS = {t: [o for o in kind if o != t] for kind in IDENTITIES for t in kind}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> tuple[int, ...]:
    """Numbers of a word and of its first 4, 5 and 6 letters."""
    keys = [f"={word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return tuple(zlib.crc32(k.encode()) % SIZE for k in keys)


class Words(dict):
    """Features of words; emptied when full."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        if len(self) >= KNOWN:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def extractor():
    """Features of a text: indicators of its words in lower case and of their beginnings."""
    known = Words()

    def features(text: str) -> np.ndarray:
        words = set(WORD.findall(text.lower()))
        return np.array(sorted({f for w in words for f in known[w]}), np.int32)

    return features


def swap_extractor(swaps: int = SWAPS):
    """Feature sets of sentences with an identity term, each beside its rewritten forms.

    One list for a text: for each such sentence and each of up to ``swaps`` other
    terms of the kind, the sets that the swap takes away and adds, as
    ``[n, taken..., m, added...]``. A term is also swapped for none, so that its
    mention counts as little as which group it names.
    """
    def features(text: str) -> np.ndarray:
        out: set[tuple] = set()
        for sentence in SENTENCE.findall(text.lower()):
            words = set(WORD.findall(sentence))
            for term in words & OTHERS.keys():
                others = OTHERS[term]
                turn = zlib.crc32(sentence.encode()) % len(others)
                had = {f for w in words for f in word_features(w)}
                for other in (None, *(others[turn:] + others[:turn])[:swaps]):
                    swapped = words - {term} | ({other} - {None})
                    has = {f for w in swapped for f in word_features(w)}
                    out.add((tuple(sorted(had - has)), tuple(sorted(has - had))))
        flat = [x for gone, new in sorted(out) for x in (len(gone), *gone, len(new), *new)]
        return np.array(flat, np.int32)

    return features


def read_swaps(lists: list[np.ndarray]) -> tuple[Rows, Rows]:
    gone, new = [], []
    for flat in lists:
        at = 0
        while at < len(flat):
            n = int(flat[at])
            gone.append(flat[at + 1 : at + 1 + n])
            at += 1 + n
            m = int(flat[at])
            new.append(flat[at + 1 : at + 1 + m])
            at += 1 + m
    return Rows.of(gone), Rows.of(new)


def favoured(rows: Rows, positive: np.ndarray, size: int) -> np.ndarray:
    """Features that the toxic class has more often than chance explains.

    By the likelihood ratio of a feature's two shares, against the bound that the
    largest of as many chance values stays below.
    """
    hits, misses = class_counts(rows, positive, size)
    count, share = hits + misses, positive.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(hits * np.log(hits / (count * share)))
        gain += np.nan_to_num(misses * np.log(misses / (count * (1 - share))))
    return (hits > count * share) & (gain >= np.log(max(2, np.count_nonzero(count))))


def fit(
    rows: Rows, positive: np.ndarray, gone: Rows, new: Rows,
    penalty: float = PENALTY, ridge: float = 1e-4, steps: int = 400,
) -> Model:
    """Logistic regression with a price on score changes under swapped terms.

    Uses the features that toxic texts clearly favour and those of the swaps, scaled
    by class log-count ratios. Weights are not negative: in a long text, harmless
    words do not outweigh an insult. Minimises the mean log loss plus ``ridge`` times
    the squared weights plus ``penalty`` times the mean squared change of the margin
    over the swaps, by gradient steps with momentum and a step size for each weight.
    Without both classes the model is a constant.
    """
    share = (positive.sum() + 1) / (len(positive) + 2)
    intercept = float(np.log(share / (1 - share)))
    if not positive.any() or positive.all():
        return Model(np.zeros(SIZE), intercept)
    wanted = favoured(rows, positive, SIZE)
    wanted[gone.features] = wanted[new.features] = True
    used = np.flatnonzero(wanted)
    place = np.zeros(SIZE, np.int64)
    place[used] = np.arange(len(used))
    own = rows.only(wanted)
    own, gone, new = (Rows(place[r.features], r.starts) for r in (own, gone, new))
    size = len(used)
    scale = np.maximum(log_ratios(own, positive, size), 0.5)
    weights, bias = np.zeros(size), intercept
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        margin = own.sums(weights * scale) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - positive) / len(positive)
        gradient = own.spread(error, size) * scale + ridge * weights
        if len(gone):
            change = new.sums(weights * scale) - gone.sums(weights * scale)
            push = 2 * penalty * change / len(change)
            gradient += (new.spread(push, size) - gone.spread(push, size)) * scale
        gradient = np.append(gradient, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        move = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights = np.maximum(weights - 0.03 * move[:-1], 0.0)
        bias -= 0.03 * move[-1]
    full = np.zeros(SIZE)
    full[used] = weights * scale
    return Model(full, float(bias))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label: str = "toxic", limit: int = SAMPLE, swaps: int = SWAPS, penalty: float = PENALTY,
) -> Model:
    """Fit on at most ``limit`` labelled documents outside the held-out fold.

    ``swaps`` is how many other terms of its kind stand in for each identity term of a
    sentence, besides none, and ``penalty`` the price of what that changes.
    """

    def both():
        words, rewritten = extractor(), swap_extractor(swaps)

        def features(text: str) -> np.ndarray:
            own = words(text)
            return np.concatenate([[len(own)], own, rewritten(text)]).astype(np.int32)

        return features

    sample = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, both, id_column, text_column, limit)
    lists = [np.frombuffer(f, "<i4") for f, _ in sample]
    positive = np.array([y == 1 for _, y in sample], bool)
    rows = Rows.of([x[1 : 1 + x[0]] for x in lists])
    changes = read_swaps([x[1 + x[0] :] for x in lists])
    del sample, lists  # the fit needs their memory
    return fit(rows, positive, *changes, penalty=penalty)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    threshold: float = THRESHOLD, limit: int = SAMPLE, swaps: int = SWAPS, penalty: float = PENALTY,
) -> DataFrame:
    """``(id, held_out, score, predicted)`` for each document, whole texts.

    The score is the chance that a document is toxic. Null texts count as empty, a
    null id as not held out. Rows are judged one by one, so order and repetition do
    not matter. Without labels all scores are one half.
    """
    model = train(docs, labels, id_column, text_column, limit=limit, swaps=swaps, penalty=penalty)
    return judged(docs, model, extractor, FOLDS, HELD_OUT, id_column, text_column, threshold)
