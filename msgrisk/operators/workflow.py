"""The full analysis of a message: first pass, links, pages, second pass.

Each stage maps DataFrame to DataFrame, so stages chain with ``transform``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions import urls, verdicts
from msgrisk.operators import evidence, replies, scoring
from msgrisk.operators.pages import RECORD, attach_pages, link_state


def _asked(
    df: DataFrame, scorer: scoring.Scorer, text: str, into: str, accept, attempts: int,
    kept: str | None,
) -> DataFrame:
    """Add a scorer's replies, from the table of replies at ``kept`` if there is one."""
    if kept is not None:
        return replies.with_kept_reply(df, scorer, kept, into, text, into, accept, attempts)
    return df.withColumn(into, scoring.reply_column(F.col(text), scorer, accept=accept, attempts=attempts))


def first_pass(
    df: DataFrame, analyst: scoring.Scorer, text: str = "text", attempts: int = 1,
    kept: str | None = None,
) -> DataFrame:
    """Add ``first``: the reply of the first pass, or why it failed.

    With ``kept``, the path of a table of replies, a text that has one is not asked about.
    """
    return _asked(df, analyst, text, "first", scoring.any_text, attempts, kept)


def with_links(
    df: DataFrame, text: str = "text", pattern: str = rubric.URL_FULL
) -> DataFrame:
    return df.withColumn("urls", urls.extract_urls(F.col(text), pattern))


def second_pass(
    df: DataFrame, judge: scoring.Scorer, text: str = "text", attempts: int = 1,
    accept=scoring.any_text, kept: str | None = None,
) -> DataFrame:
    """Add ``second``, asked only where the first pass gave an answer."""
    document = evidence.evidence_document(F.col(text), F.col("first.reply"), F.col("pages"))
    asked = F.when(_answered("first"), document)
    return _asked(df.withColumn("evidence", asked), judge, "evidence", "second", accept, attempts, kept)


def _answered(stage: str) -> Column:
    reply = F.col(f"{stage}.reply")
    return F.col(f"{stage}.error").isNull() & reply.isNotNull() & (reply != "")


def _problem(stage: str, step: int) -> Column:
    reason = F.coalesce(F.col(f"{stage}.error"), F.lit(rubric.EMPTY_REPLY))
    return F.concat(F.lit(rubric.STEP_FAILED[step]), reason)


def _step(number: int, result: Column) -> Column:
    return F.struct(
        F.lit(number).alias("step"),
        F.lit(rubric.STEP_NAMES[number]).alias("name"),
        result.alias("result"),
        F.lit("success").alias("status"),
    )


def as_result(df: DataFrame, text: str = "text", timestamp: Column | None = None) -> DataFrame:
    """Replace the stage columns by the workflow result of each message."""
    one, two = _answered("first"), _answered("second")
    extracted = F.to_json(F.struct(F.col("urls").alias("extracted_urls")))
    pages = F.to_json(F.transform("pages", lambda p: F.struct(*[p[c].alias(c) for c in RECORD])))
    steps = F.array_compact(
        F.array(
            F.when(one, _step(1, F.col("first.reply"))),
            F.when(one, _step(2, extracted)),
            F.when(one & (F.size("urls") > 0), _step(3, pages)),
            F.when(one & two, _step(4, F.col("second.reply"))),
        )
    )
    status = F.when(~one, "failed").when(~two, "partial_failure").otherwise("completed")
    results = {
        "input_text": F.col(text),
        "workflow_steps": steps,
        "final_analysis": F.when(one & two, F.col("second.reply")).otherwise(""),
        "timestamp": F.current_timestamp() if timestamp is None else timestamp,
        "status": status,
        "error": F.when(~one, _problem("first", 1)).when(~two, _problem("second", 4)),
        "failed_step": F.when(~one, 1).when(~two, 4),
        "stopped_at": F.lit(None).cast("string"),
    }
    stages = ("first", "second", "urls", "pages", "evidence", text)
    kept = [c for c in df.columns if c not in stages]
    return df.select(*kept, *[value.alias(name) for name, value in results.items()])


def analyze(
    messages: DataFrame,
    pages: DataFrame,
    analyst: scoring.Scorer,
    judge: scoring.Scorer,
    message: str = "msg_id",
    text: str = "text",
    pattern: str = rubric.URL_FULL,
    timestamp: Column | None = None,
    kept: str | None = None,
) -> DataFrame:
    """Workflow result of each message. ``pages`` is unique by key.

    With ``kept``, a path, replies of both passes are kept there: a run that is cut off, or
    comes later with more messages, asks about no text or evidence that has a reply.
    """
    return (
        messages.select(message, text)
        .transform(with_links, text, pattern)
        .transform(attach_pages, pages, message)
        .transform(first_pass, analyst, text, 1, kept)
        .transform(second_pass, judge, text, 1, scoring.any_text, kept)
        .transform(as_result, text, timestamp)
    )


def rate(
    messages: DataFrame,
    pages: DataFrame,
    analyst: scoring.Scorer,
    judge: scoring.Scorer,
    message: str = "msg_id",
    text: str = "text",
    pattern: str = rubric.URL_FULL,
    attempts: int = scoring.ATTEMPTS,
    kept: str | None = None,
) -> DataFrame:
    """``message, text, rating, final_analysis, error``: datasets through the workflow.

    Each stage asks again for failed rows only, up to ``attempts`` times; the second
    has failed as long as its reply holds no rating. A row that fails in the end,
    and one without text, is rated 0. ``kept`` is as for ``analyze``.
    """
    asked = messages.select(message, text).transform(with_links, text, pattern)
    rows = (
        asked.transform(attach_pages, pages, message)
        .transform(first_pass, analyst, text, attempts, kept)
        .transform(second_pass, judge, text, attempts, scoring.readable_rating, kept)
    )
    verdict = verdicts.parse_verdict(F.col("second.reply"))
    return rows.withColumn("_verdict", verdict).select(
        message,
        text,
        F.coalesce(verdicts.accepted_rating(F.col("_verdict.rating")), F.lit(0.0)).alias("rating"),
        F.col("second.reply").alias("final_analysis"),
        F.coalesce("first.error", "second.error").alias("error"),
    )


def rule_analysis(
    messages: DataFrame,
    pages: DataFrame,
    message: str = "msg_id",
    text: str = "text",
    pattern: str = rubric.URL_FULL,
    terms=rubric.RISK_KEYWORDS,
) -> DataFrame:
    """Rule verdict of each message, its links and pages taken into account."""


    rows = (
        messages.select(message, text)
        .transform(with_links, text, pattern)
        .transform(attach_pages, pages, message)
    )
    rows = rows.withColumn("link_state", link_state(F.col("pages"), terms))
    return scoring.rule_verdict(rows, text, F.col("link_state"), terms).drop("pages")


