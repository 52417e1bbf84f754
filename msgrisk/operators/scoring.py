"""Scoring tables of messages with a pluggable scorer.

A scorer is a callable ``list[str] -> list[str | None]``: texts in, raw replies
out, in the same order. Spark partitions the work and hands it over in Arrow
batches; only the text column leaves the JVM. The rule scorer needs no Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk import rubric, schemas
from msgrisk.functions import grading, lexicon, verdicts

Scorer = Callable[[list[str]], list[str | None]]

REPLY = "reply string, attempts int, error string"
ATTEMPTS = 3


def readable_rating(reply: str | None) -> bool:
    """Whether a reply holds a verdict with a rating above zero."""
    span = re.search(r"\{.*\}", reply or "", re.DOTALL)
    if span is None:
        return False
    try:
        rating = json.loads(span.group()).get("rating", 0)
        return not isinstance(rating, bool) and rating > 0
    except (ValueError, AttributeError, TypeError):
        return False


def any_text(reply: str | None) -> bool:
    return bool(reply)


def _call(scorer: Scorer, texts: list[str]) -> list[tuple[str | None, str | None]]:
    """Replies and errors; a failing batch is halved until the failing items are alone."""
    try:
        replies = list(scorer(texts))
        if len(replies) != len(texts):
            raise ValueError("the scorer returned a wrong number of replies")
        return [(r, None) for r in replies]
    except Exception as problem:
        if len(texts) == 1:
            return [(None, str(problem))]
        middle = len(texts) // 2
        return _call(scorer, texts[:middle]) + _call(scorer, texts[middle:])


def score_texts(
    texts: list[str],
    scorer: Scorer,
    accept: Callable[[str | None], bool] = readable_rating,
    attempts: int = ATTEMPTS,
) -> list[tuple[str | None, int, str | None]]:
    """Reply, attempts made and last error of each text; only failures are retried."""
    results: list[tuple[str | None, int, str | None]] = [(None, 0, None)] * len(texts)
    open_items = list(range(len(texts)))
    for attempt in range(1, attempts + 1):
        if not open_items:
            break
        replies = _call(scorer, [texts[i] for i in open_items])
        still_open = []
        for i, (reply, error) in zip(open_items, replies):
            results[i] = (reply, attempt, error)
            if error is not None or not accept(reply):
                still_open.append(i)
        open_items = still_open
    return results


def reply_column(
    text: Column,
    scorer: Scorer,
    accept: Callable[[str | None], bool] = readable_rating,
    attempts: int = ATTEMPTS,
) -> Column:
    """Struct ``reply, attempts, error`` for each text; null stays unscored."""

    @F.pandas_udf(REPLY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(None, 0, None)] * len(batch)
            asked = [i for i, text in enumerate(batch) if text is not None]
            replies = score_texts([batch.iloc[i] for i in asked], scorer, accept, attempts)
            for i, row in zip(asked, replies):
                rows[i] = row
            yield pd.DataFrame(rows, columns=["reply", "attempts", "error"])

    # A model call must not be repeated by plan rewrites.
    return run.asNondeterministic()(text)


def score_batch(
    df: DataFrame, scorer: Scorer, content: str = "content", distinct: bool = True
) -> DataFrame:
    """Add ``verdict, rating, attempts, error``; a failed row is rated 0.

    Missing content counts as empty text and is rated 0 without a call. With
    ``distinct`` each text is scored once and joined back by its SHA-256 digest
    and length, so that the replies and not the texts travel a second time. The
    distinct step combines copies before its shuffle. The join back splits a
    text that holds a large share of the rows: it is an adaptive skew join, and
    the length as second column gives it the shuffle below both sides it needs.
    """
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    rows = df.drop("rating")
    if distinct:
        keys = {"_digest": F.sha2(F.col("_text"), 256), "_size": F.length("_text")}
        unique = rows.select(text.alias("_text")).distinct()
        asked = F.when(F.col("_text") != "", F.col("_text"))
        scored = unique.withColumn("_scored", reply_column(asked, scorer)).withColumns(keys)
        of_row = {"_digest": F.sha2(text, 256), "_size": F.length(text)}
        rows = rows.withColumns(of_row).join(
            scored.select(*keys, "_scored"), list(keys), "left"
        )
    else:
        rows = rows.withColumn("_scored", reply_column(F.when(text != "", text), scorer))
    verdict = verdicts.parse_verdict(F.col("_scored.reply"))
    return (
        rows.withColumn("verdict", verdict)
        .withColumn("rating", verdicts.accepted_rating(F.col("verdict.rating")))
        .withColumn("attempts", F.col("_scored.attempts"))
        .withColumn("error", F.col("_scored.error"))
        .drop("_digest", "_size", "_scored")
    )


def score_conversations(df: DataFrame, scorer: Scorer, snippet: str = "snippet") -> DataFrame:
    """Add the raw ``reply``, its ``verdict`` and, on failure, an error record.

    One attempt per snippet. ``error`` is ``agent_failure`` and
    ``error_message`` says why; both are null on success.
    """
    scored = df.withColumn(
        "_scored", reply_column(F.col(snippet), scorer, accept=any_text, attempts=1)
    )
    reply = F.col("_scored.reply")
    failed = F.col("_scored.error").isNotNull()
    return (
        scored.withColumn("reply", reply)
        .withColumn("verdict", verdicts.strict_json(verdicts.strip_fence(reply), schemas.VERDICT))
        .withColumn("error", F.when(failed, "agent_failure"))
        .withColumn("error_message", F.col("_scored.error"))
        .drop("_scored")
    )


def rule_verdict(
    df: DataFrame,
    text: str = "text",
    link_state: Column | None = None,
    terms: lexicon.Lexicon = rubric.RISK_KEYWORDS,
    signs: dict[int, list[str]] = rubric.SCAM_SIGNS,
) -> DataFrame:
    """Add a ``verdict`` made by rules from terms, signs and link state.

    A baseline without any model: all of it is one projection.
    """
    state = F.lit("none") if link_state is None else link_state
    groups = lexicon.risk_keywords(F.col(text), terms)
    rows = df.withColumns(
        {"_groups": groups, "_type": lexicon.scam_type(F.col(text), signs), "_state": state}
    )
    level = lexicon.adjusted_level(
        lexicon.level_of(lexicon.risk_score(F.col("_groups"), terms)), F.col("_state")
    ).cast("double")
    keywords = lexicon.all_keywords(F.col("_groups"), terms)
    rows = rows.withColumns({"_level": level, "_keywords": keywords})
    verdict = F.struct(
        F.col("_level").alias("rating"),
        F.coalesce("_type.name", F.lit("")).alias("fraud_type"),
        F.concat(F.lit("terms: "), F.array_join("_keywords", ", ")).alias("reasoning"),
        grading.advice(F.col("_level")).alias("advice"),
        F.concat(F.lit("links: "), F.col("_state")).alias("url_analysis"),
        F.col("_keywords").alias("risk_keywords"),
    )
    return rows.withColumn("verdict", verdict).drop(
        "_groups", "_type", "_state", "_level", "_keywords"
    )


def with_notice(df: DataFrame) -> DataFrame:
    """Add ``rating, reasoning, advice, tier`` taken from ``verdict``."""
    return df.withColumns(
        {
            "rating": F.col("verdict.rating"),
            "reasoning": F.col("verdict.reasoning"),
            "advice": F.col("verdict.advice"),
            "tier": grading.action_tier(F.col("verdict.rating")),
        }
    )

