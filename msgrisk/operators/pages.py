"""Links of messages joined to the text of the pages behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions import html, lexicon, urls
from msgrisk.functions.text import let

RECORD = ["url", "title", "content", "status", "method", "error"]


def page_records(pages: DataFrame, method: str, url: str = "url", markup: str = "html") -> DataFrame:
    """Page records ``key, url, title, content, status, method, error``.

    The text is made once per page, here, not once per message that links to it.
    Pages without markup are failures.
    """
    shown = pages.select(
        F.col(url).alias("url"), html.visible(F.col(markup)).alias("_visible")
    )
    failed = F.col("_visible").isNull()
    return shown.select(
        urls.url_key(F.col("url")).alias("key"),
        "url",
        F.when(~failed, html.title_of_visible(F.col("_visible"))).alias("title"),
        html.text_of_visible(F.col("_visible")).alias("content"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.lit(method).alias("method"),
        F.when(failed, rubric.UNKNOWN_ERROR).alias("error"),
    )


def resolve_sources(sources: list[DataFrame]) -> DataFrame:
    """One record per key: the first source with a success, else the last failure.

    Sources come in order of preference. Resolving them before the join to the
    messages costs one aggregation instead of one join per source.
    """
    ranked = None
    for rank, source in enumerate(sources):
        part = source.select("key", F.lit(rank).alias("_rank"), *RECORD)
        ranked = part if ranked is None else ranked.unionByName(part)
    failed = F.col("status") != "success"
    # Successes first by preference, then failures from the last source back.
    order = F.struct(
        failed, F.when(failed, -F.col("_rank")).otherwise(F.col("_rank")), F.col("url")
    )
    best = F.min_by(F.struct(*RECORD), order).alias("page")
    return ranked.groupBy("key").agg(best)


def link_pages(
    messages: DataFrame, pages: DataFrame, message: str = "msg_id", links: str = "urls"
) -> DataFrame:
    """One row per link: ``message, position, url`` and the page record fields.

    ``pages`` is the output of ``resolve_sources``, unique by key. A link with
    no page gets a failure record. Only ids and links are shuffled, and a link
    that many messages share is split by Spark's adaptive skew join.

    That join needs a shuffle directly below both sides. The page side would
    reuse the one of its aggregation by key, so the host joins in as a second
    column: it changes no result, but asks for a shuffle of its own.
    """
    # The outer form, as the plain one would compute the list again for a filter.
    listed = messages.select(message, F.posexplode_outer(links).alias("position", "link"))
    pairs = listed.filter(F.col("link").isNotNull()).withColumn(
        "key", urls.url_key(F.col("link"))
    )
    hosted = [df.withColumn("_host", urls.key_host(F.col("key"))) for df in (pairs, pages)]
    found = hosted[0].join(hosted[1], ["key", "_host"], "left")
    page = F.col("page")
    absent = F.concat(F.lit(rubric.FETCH_FAILED), F.col("link"))
    return found.select(
        message,
        "position",
        F.col("link").alias("url"),
        page["title"].alias("title"),
        page["content"].alias("content"),
        F.coalesce(page["status"], F.lit("error")).alias("status"),
        page["method"].alias("method"),
        F.when(page.isNull(), absent).otherwise(page["error"]).alias("error"),
    )


def wanted_keys(messages: DataFrame, links: str = "urls") -> DataFrame:
    """``key``: the join key of each link of the messages, repeats included."""
    link = messages.select(F.explode(links).alias("link"))
    return link.filter(F.col("link").isNotNull()).select(urls.url_key(F.col("link")).alias("key"))


def gather_pages(linked: DataFrame, message: str = "msg_id") -> DataFrame:
    """The page records of each message as a list in link order."""
    record = F.struct("position", *RECORD)
    return linked.groupBy(message).agg(F.sort_array(F.collect_list(record)).alias("pages"))


def attach_pages(
    messages: DataFrame, pages: DataFrame, message: str = "msg_id", links: str = "urls"
) -> DataFrame:
    """Add ``pages`` to the messages; an empty list where a message has no link.

    Only messages with links are joined, the others pass by. The links are read
    back from the page list.
    """
    has_links = F.size(links) > 0
    linked = messages.filter(has_links)
    gathered = gather_pages(link_pages(linked, pages, message, links), message)
    kind = gathered.schema["pages"].dataType
    joined = linked.join(gathered, message, "left")
    alone = messages.filter(~F.coalesce(has_links, F.lit(False)))
    both = joined.unionByName(alone.withColumn("pages", F.lit(None).cast(kind)))
    return (
        both.drop(links)
        .withColumn("pages", F.coalesce("pages", F.array().cast(kind)))
        .withColumn(links, F.transform("pages", lambda p: p["url"]))
    )


def link_state(
    pages: Column, terms: lexicon.Lexicon = rubric.RISK_KEYWORDS, suspicious_score: int = 4
) -> Column:
    """none, suspicious, clean or unreachable, from the page list of a message.

    One suspicious page decides; else one readable page makes the links clean.
    """

    def suspicious(page: Column) -> Column:
        text = F.concat_ws(" ", page["title"], page["content"])
        return let(
            lexicon.risk_keywords(text, terms),
            lambda groups: lexicon.risk_score(groups, terms) >= suspicious_score,
        )

    def state(listed: Column) -> Column:
        ok = F.filter(listed, lambda p: p["status"] == "success")
        return (
            F.when(F.size(listed) == 0, "none")
            .when(F.exists(ok, suspicious), "suspicious")
            .when(F.size(ok) > 0, "clean")
            .otherwise("unreachable")
        )

    return let(pages, state)
