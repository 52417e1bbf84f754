"""The registered queries: one function of (spark, sf_dir) per operator."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from msgrisk import rubric
from msgrisk.functions import chat, grading, html, lexicon, urls, verdicts
from msgrisk.operators import (
    answers,
    callbacks,
    evidence,
    history,
    labels,
    metrics,
    notices,
    pages,
    replies,
    scoring,
    terms,
    tools,
    workflow,
)
from msgrisk.plans import views
from msgrisk.session import scratch_path
from msgrisk.sinks import results, writers
from msgrisk.sources import callbacks as request_source
from msgrisk.sources import datasets, pagestore, records, sheets
from msgrisk.sources import pages as page_store
from msgrisk.streaming import counters, monitor
from msgrisk.streaming import datasets as stream_datasets

PAIR = ["account_low", "account_high"]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that engines agree on the last digits."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), 6).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.clean(views.rated(spark, sf_dir))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.matrix(_clean(spark, sf_dir))


# -- ratings and metrics ----------------------------------------------------


def labels_scan_by_sheet(spark, sf_dir):
    return views.rated(spark, sf_dir).groupBy("sheet").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("human rating").alias("n_human"),
        F.count("rating").alias("n_rating"),
    )


def eval_clean(spark, sf_dir):
    return rounded(_clean(spark, sf_dir))


def clean_counts(spark, sf_dir):
    return metrics.clean_counts(views.rated(spark, sf_dir), by=["sheet"])


def rating_distribution(spark, sf_dir):
    return metrics.rating_distribution(_clean(spark, sf_dir))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_clean(spark, sf_dir))


def confusion_norm(spark, sf_dir):
    return rounded(metrics.confusion_shares(_clean(spark, sf_dir)))


def qwk(spark, sf_dir):
    return rounded(metrics.with_qwk(_matrix(spark, sf_dir)).select("qwk"))


def qwk_band(spark, sf_dir):
    by_sheet = metrics.matrix(_clean(spark, sf_dir), ["sheet"])
    return metrics.with_qwk(by_sheet).select("sheet", "qwk_interpretation")


def mae(spark, sf_dir):
    return rounded(metrics.with_mae(_matrix(spark, sf_dir)).select("mae"))


def f1_macro_weighted(spark, sf_dir):
    return rounded(metrics.with_f1(_matrix(spark, sf_dir)).select("macro_f1", "weighted_f1"))


def high_risk_pr(spark, sf_dir):
    rows = metrics.with_high_risk(_matrix(spark, sf_dir))
    return rounded(rows.select("high_risk_recall", "high_risk_precision"))


def low_risk_rates(spark, sf_dir):
    rows = metrics.with_low_risk(_matrix(spark, sf_dir))
    return rounded(rows.select("fpr_low_risk", "low_risk_recall", "low_risk_precision"))


def binary_f1(spark, sf_dir):
    rows = metrics.with_low_risk(metrics.with_high_risk(_matrix(spark, sf_dir)))
    names = [f"{s}_risk_{k}_f1" for s in ("high", "low") for k in ("macro", "weighted")]
    return rounded(rows.select(*names))


def cost_error(spark, sf_dir):
    return rounded(metrics.with_cost(_matrix(spark, sf_dir)).select("avg_cost"))


def error_direction(spark, sf_dir):
    return rounded(metrics.error_direction(_clean(spark, sf_dir)))


def level_report(spark, sf_dir):
    return rounded(metrics.level_report(_clean(spark, sf_dir)))


def level_pred_dist(spark, sf_dir):
    return rounded(metrics.level_predictions(_clean(spark, sf_dir)))


def dist_compare(spark, sf_dir):
    return metrics.distribution_comparison(_clean(spark, sf_dir))


def error_hist(spark, sf_dir):
    return metrics.error_histogram(_clean(spark, sf_dir))


def level_accuracy(spark, sf_dir):
    return rounded(metrics.level_accuracy(_clean(spark, sf_dir)))


def eval_summary(spark, sf_dir):
    return rounded(metrics.summary(_clean(spark, sf_dir)))


def eval_summary_by_sheet(spark, sf_dir):
    return rounded(metrics.summary(_clean(spark, sf_dir), ["sheet"]))


def eval_verdicts(spark, sf_dir):
    summary = metrics.summary(_clean(spark, sf_dir))
    return rounded(metrics.verdicts(summary))


def metrics_json(spark, sf_dir):
    names = [m for m in (*metrics.MAIN, *metrics.AUXILIARY) if m != "qwk_interpretation"]
    schema = ", ".join(f"{n} double" for n in names) + ", qwk_interpretation string"
    text = metrics.metrics_json(_clean(spark, sf_dir), ["sheet"])
    record = F.from_json("metrics", f"{schema}, total_samples bigint")
    return rounded(text.select("sheet", record.alias("m")).select("sheet", "m.*"))


def dataset_counts(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    return metrics.dataset_counts(docs.withColumnRenamed("source", "dataset"))


def label_zip(spark, sf_dir):
    return rounded(
        labels.zip_labels(views.sheet_labels(spark, sf_dir), views.sheet_ratings(spark, sf_dir))
    )


# -- chat callbacks -----------------------------------------------------------


def _validated(spark, sf_dir):
    requests = views.callback_requests(spark, sf_dir)
    return callbacks.validate(callbacks.parse(requests), views.APP_ID)


def callback_parse(spark, sf_dir):
    rows = callbacks.parse(views.callback_requests(spark, sf_dir))
    return rows.select(
        "event_id",
        "from_account",
        "to_account",
        "msg_seq",
        F.unix_seconds("msg_time").alias("msg_seconds"),
        F.unix_millis("event_time").alias("event_millis"),
        F.size("data.MsgBody").cast("bigint").alias("n_elements"),
    )


def first_text(spark, sf_dir):
    return callbacks.parse(views.callback_requests(spark, sf_dir)).select("event_id", "text")


def callback_validate(spark, sf_dir):
    rows = _validated(spark, sf_dir)
    return rows.select("event_id", "error_info", chat.http_status(F.col("error_info")).alias("http"))


def callback_reject_reasons(spark, sf_dir):
    rows = callbacks.rejected(_validated(spark, sf_dir))
    return rows.groupBy("error_info").agg(F.count(F.lit(1)).alias("n"))


def callback_route_counts(spark, sf_dir):
    rows = callbacks.routed(callbacks.accepted(_validated(spark, sf_dir)))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def conv_key(spark, sf_dir):
    rows = callbacks.keyed(callbacks.parse(views.callback_requests(spark, sf_dir)))
    return rows.select("event_id", "account_low", "account_high", "conversation")


def action_tier(spark, sf_dir):
    rows = callbacks.tiered(views.chat_events(spark, sf_dir))
    return rows.select("event_id", "rating", "tier")


def advice_tier(spark, sf_dir):
    rows = views.chat_events(spark, sf_dir)
    return rows.select("event_id", grading.advice(F.col("rating")).alias("advice"))


def alert_payload(spark, sf_dir):
    rows = callbacks.alerts(views.chat_events(spark, sf_dir), nonce=F.col("event_id"))
    return rows.select("event_id", "payload")


def _noticed(spark, sf_dir, scope="conversation", rows_per_task=None):
    events = callbacks.keyed(views.chat_events(spark, sf_dir))
    return notices.inject_notices(events, PAIR, "event_id", scope, rows_per_task)


def notice_injection(spark, sf_dir):
    rows = _noticed(spark, sf_dir)
    message = F.when(
        F.col("notice").isNotNull(), chat.noticed_message(F.col("notice"), F.col("text"))
    )
    return rows.select("event_id", "conversation", "kind", "notice", message.alias("message"))


def notice_injection_global(spark, sf_dir):
    return _noticed(spark, sf_dir, "global", 2000).select("event_id", "kind", "notice")


def _answered(spark, sf_dir):
    return answers.answer(views.callback_requests(spark, sf_dir), views.APP_ID, "event_id")


def callback_response(spark, sf_dir):
    return _answered(spark, sf_dir).select(
        "event_id",
        "http_status",
        F.col("response.ActionStatus").alias("action_status"),
        F.col("response.ErrorInfo").alias("error_info"),
        F.col("response.ErrorCode").alias("error_code"),
        F.get("response.MsgBody", F.lit(0))["MsgContent"]["Text"].alias("new_text"),
    )


def callback_alerts(spark, sf_dir):
    rows = answers.alerts(_answered(spark, sf_dir), nonce=F.col("event_id"))
    return rows.select("event_id", "conversation", "payload")


def last3_messages(spark, sf_dir):
    rows = history.last_messages(views.turns(spark, sf_dir), ["conv_id"], "turn", who="role")
    return rows.select("conv_id", "turn", F.size("last_messages").alias("n"), "snippet")


def last3_chat_events(spark, sf_dir):
    events = callbacks.keyed(views.chat_events(spark, sf_dir)).filter(F.col("kind") == "after")
    rows = history.last_messages(events, PAIR, "event_id", who="from_account")
    return rows.select("event_id", "conversation", "snippet")


def last3_one_chat(spark, sf_dir):
    """All events as the messages of one chat, far above the rows of a task."""
    chat_rows = views.chat_events(spark, sf_dir).withColumn("chat", F.lit(1))
    rows = history.last_messages(chat_rows, ["chat"], "event_id", who="from_account", rows_per_task=1000)
    return rows.select("event_id", "snippet")


def chat_messages(spark, sf_dir):
    rows = history.chat_messages(views.turns(spark, sf_dir))
    return rows.select(
        "conv_id", "turn", F.col("message.role").alias("role"), F.col("message.content").alias("content")
    )


# -- links and pages ----------------------------------------------------------


def url_extract(spark, sf_dir):
    docs = views.texts(spark, sf_dir, "documents", "doc_id", "text")
    found = docs.select("doc_id", urls.extract_urls(F.col("text")).alias("urls"))
    return found.select(
        "doc_id", F.size("urls").alias("n"), F.array_join("urls", " ").alias("urls")
    )


def url_extract_full(spark, sf_dir):
    pages_ = views.texts(spark, sf_dir, "pages", "page_id", "html")
    found = pages_.select(
        "page_id", urls.extract_urls(F.col("html"), rubric.URL_FULL).alias("urls")
    )
    return found.select(
        "page_id", F.size("urls").alias("n"), F.array_join("urls", " ").alias("urls")
    )


def url_maximal(spark, sf_dir):
    messages = views.linked_messages(spark, sf_dir)
    found = urls.longest_first(urls.find_urls(F.col("text"), rubric.URL_FULL))
    rows = messages.select("msg_id", found.alias("found"))
    return rows.select(
        "msg_id",
        F.size("found").alias("n_found"),
        F.array_join(urls.maximal(F.col("found")), " ").alias("kept"),
    )


def page_text(spark, sf_dir):
    return views.texts(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id", html.page_text(F.col("html")).alias("content")
    )


def page_title(spark, sf_dir):
    return views.texts(spark, sf_dir, "pages", "page_id", "html").select(
        "page_id", html.page_title(F.col("html")).alias("title")
    )


def _page_store(spark, sf_dir):
    store = views.texts(spark, sf_dir, "pages", "url", "html")
    return pages.resolve_sources([pages.page_records(store, "store")])


def _with_links(spark, sf_dir):
    return workflow.with_links(views.linked_messages(spark, sf_dir))


def url_page_join(spark, sf_dir):
    rows = pages.link_pages(_with_links(spark, sf_dir), _page_store(spark, sf_dir))
    return rows.select(
        "msg_id", "position", "url", "title", "status", "error",
        F.length("content").alias("n_chars"),
    )


def page_store_join(spark, sf_dir):
    """The links of messages joined to a store of pages that was written in two versions."""
    path = scratch_path(spark, "page-store")
    table = views.texts(spark, sf_dir, "pages", "page_id", "url", "html")
    for lot in (0, 1):
        some = table.filter(F.col("page_id") % 2 == lot)
        pagestore.add_pages(pages.page_records(some, "store"), path)
    linked = _with_links(spark, sf_dir)
    rows = pages.link_pages(linked, pagestore.wanted_pages(pages.wanted_keys(linked), path))
    return rows.select(
        "msg_id", "position", "url", "title", "status", "error",
        F.length("content").alias("n_chars"),
    )


def _three_sources(spark, sf_dir):
    """The page table seen by three fetchers, each of which fails on some pages."""
    table = views.texts(spark, sf_dir, "pages", "page_id", "url", "html")

    def seen(method, works):
        markup = F.when(works, F.col("html"))
        return pages.page_records(table.withColumn("html", markup), method)

    at = F.col("page_id")
    return [
        seen("fetch", at % 2 == 0),
        seen("browser", at % 3 == 0),
        seen("plain", at % 5 != 1),
    ]


def page_fallback(spark, sf_dir):
    best = pages.resolve_sources(_three_sources(spark, sf_dir))
    rows = pages.link_pages(_with_links(spark, sf_dir), best)
    return rows.select(
        "msg_id", "url", "status", "method", F.length("content").alias("n_chars")
    )


def evidence_doc(spark, sf_dir):
    rows = pages.attach_pages(_with_links(spark, sf_dir), _page_store(spark, sf_dir))
    first = F.concat(F.lit("first look at "), F.col("msg_id"))
    document = evidence.evidence_document(F.col("text"), first, F.col("pages"))
    return rows.select("msg_id", document.alias("document"))


# -- replies, keywords and scores ---------------------------------------------


def verdict_parse(spark, sf_dir):
    rows = views.model_replies(spark, sf_dir)
    bare = verdicts.strip_fence(F.col("reply"))
    rows = rows.select(
        "event_id", bare.alias("bare"), verdicts.parse_verdict(F.col("reply")).alias("v")
    )
    rating = verdicts.accepted_rating(F.col("v.rating"))
    return rows.select("event_id", "bare", rating.alias("rating"), F.col("v.advice").alias("advice"))


def reply_content(spark, sf_dir):
    rows = views.model_replies(spark, sf_dir)
    content = F.when(F.col("event_id") % 9 != 0, F.col("reply")).otherwise("")
    envelope = F.to_json(
        F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    )
    return rows.select("event_id", verdicts.reply_content(envelope).alias("content"))


def risk_keywords(spark, sf_dir):
    docs = views.texts(spark, sf_dir, "documents", "doc_id", "text")
    groups = lexicon.risk_keywords(F.col("text"), views.PROSE_TERMS)
    rows = docs.select("doc_id", groups.alias("g"))
    return rows.select(
        "doc_id", *[F.array_join(f"g.{g}", ",").alias(g) for g in views.PROSE_TERMS]
    )


def terms_tagged(spark, sf_dir):
    """Documents looked up in a lexicon that is a table: all longer words of the benchmark."""
    words = views.table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("term")
    )
    lexicon = terms.lexicon_table(
        words.select("term", F.lower(F.substring("term", 1, 1)).alias("group"),
                     (F.length("term") % 3 + 1).alias("weight")),
        weight="weight",
    )
    docs = views.texts(spark, sf_dir, "documents", "doc_id", "text")
    rows = terms.with_terms(docs, "text", lexicon)
    lead = terms.leading_group(F.col("matches"))
    return rows.select(
        "doc_id", F.size("matches").alias("n_terms"), terms.weight_of(F.col("matches")).alias("weight"),
        F.md5(F.array_join(terms.terms_of(F.col("matches")), ",")).alias("terms_md5"),
        lead["group"].alias("top_group"), lead["hits"].alias("top_hits"),
    )


def fraud_type(spark, sf_dir):
    docs = views.texts(spark, sf_dir, "documents", "doc_id", "text")
    best = lexicon.scam_type(F.col("text"), views.PROSE_SIGNS)
    return docs.select("doc_id", best.alias("t")).select(
        "doc_id", F.col("t.name").alias("fraud_type"), F.col("t.hits").alias("hits")
    )


def rubric_verdict(spark, sf_dir):
    """The rubric's own signs and keywords, all scam types among them."""
    rows = views.rubric_texts(spark, sf_dir)
    best = lexicon.scam_type(F.col("text"))
    groups = lexicon.risk_keywords(F.col("text"))
    rows = rows.select("event_id", best.alias("t"), groups.alias("g"))
    return rows.select(
        "event_id", F.col("t.name").alias("fraud_type"), F.col("t.hits").alias("hits"),
        lexicon.risk_score(F.col("g")).alias("score"),
    )


def rule_rating(spark, sf_dir):
    docs = views.texts(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.withColumn("g", lexicon.risk_keywords(F.col("text"), views.PROSE_TERMS))
    score = lexicon.risk_score(F.col("g"), views.PROSE_TERMS)
    rows = rows.select("doc_id", score.alias("score"))
    return rows.select("doc_id", "score", lexicon.level_of(F.col("score")).alias("level"))


def link_rating(spark, sf_dir):
    rows = workflow.rule_analysis(
        views.linked_messages(spark, sf_dir), _page_store(spark, sf_dir), terms=views.PROSE_TERMS
    )
    return rows.select(
        "msg_id",
        "link_state",
        F.col("verdict.rating").alias("rating"),
        F.array_join("verdict.risk_keywords", ",").alias("keywords"),
    )


def length_scorer(texts: list[str]) -> list[str]:
    """A stand-in model: its rating depends on the length of the text only."""
    return [f'Result: {{"rating": {len(t) % 7 - 1}}}' for t in texts]


def length_judge(texts: list[str]) -> list[str]:
    return [json.dumps({"rating": len(t) % 5 + 1}) for t in texts]


def picky_analyst(texts: list[str]) -> list[str | None]:
    """A stand-in model that fails on some texts."""
    if any("casino" in t for t in texts):
        raise RuntimeError("refused")
    return [f"{len(t)} characters" for t in texts]


def picky_judge(texts: list[str]) -> list[str | None]:
    return ["" if "pills" in t else r for t, r in zip(texts, length_judge(texts))]


def workflow_ratings(spark, sf_dir):
    rows = workflow.rate(
        views.linked_messages(spark, sf_dir), _page_store(spark, sf_dir), picky_analyst, picky_judge
    )
    return rows.select("msg_id", "rating", "error")


def score_batch(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    rows = scoring.score_batch(docs.select("doc_id", "text"), length_scorer, "text")
    return rows.select("doc_id", "rating", "attempts")


def refusing_scorer(texts: list[str]) -> list[str]:
    """A model that must not be asked any more."""
    raise RuntimeError("asked again")


def replies_kept(spark, sf_dir):
    """Documents scored from kept replies; the second run has nothing left to ask."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "replies")
    options = {"content": "text", "texts_per_task": 5_000}
    replies.ask(docs, length_scorer, path, "length", **options)
    rows = replies.score_kept(docs, refusing_scorer, path, "length", **options)
    return rows.select("doc_id", "rating", "attempts", "error")


def score_conversations(spark, sf_dir):
    rows = history.last_messages(views.turns(spark, sf_dir), ["conv_id"], "turn", who="role")
    scored = scoring.score_conversations(rows, length_judge)
    return scored.select(
        "conv_id", "turn", F.col("verdict.rating").alias("rating"), "error", "error_message"
    )


def workflow_result(spark, sf_dir):
    rows = workflow.analyze(
        views.linked_messages(spark, sf_dir), _page_store(spark, sf_dir), picky_analyst, picky_judge
    )
    names = F.transform("workflow_steps", lambda s: s["name"])
    return rows.select(
        "msg_id",
        "input_text",
        F.array_join(names, ",").alias("steps"),
        "final_analysis",
        "status",
        "error",
        "failed_step",
    )


def workflow_records(spark, sf_dir):
    """Workflow results written as JSON records and read back, with their time stamps."""
    rows = workflow.analyze(
        views.linked_messages(spark, sf_dir), _page_store(spark, sf_dir), picky_analyst, picky_judge
    )
    path = scratch_path(spark, "workflow-records")
    writers.write_workflow_results(rows, path)
    steps = "array<struct<step: int, name: string, result: string, status: string>>"
    schema = (
        f"msg_id bigint, input_text string, workflow_steps {steps}, final_analysis string, "
        "timestamp timestamp, status string, error string, failed_step int"
    )
    back = spark.read.schema(schema).json(path)
    return back.select(
        "msg_id", "input_text", F.array_join("workflow_steps.name", ",").alias("steps"), "final_analysis",
        "status", "error", "failed_step", (F.col("timestamp") <= F.current_timestamp()).alias("stamped"),
    )


def picky_length(texts: list[str]) -> list[dict]:
    """A user's tool that gives records and refuses some texts."""
    if any("thth" in t for t in texts):
        raise ValueError("refused")
    return [{"n_chars": len(t), "head": t[:10]} for t in texts]


def tool_calls(spark, sf_dir):
    """Each turn asks for tools: an expression, a function of texts, one of records, none."""
    turns = views.turns(spark, sf_dir).filter(F.col("text").isNotNull())
    names = ["shout", "reverse", "length", "missing"]
    args = F.create_map(F.lit("text"), F.col("text")).alias("args")
    call = [F.struct(F.lit(f"c{i}").alias("id"), F.lit(n).alias("name"), args) for i, n in enumerate(names)]
    asked = turns.select("conv_id", "turn", F.array(*call).alias("tool_calls"))
    made = tools.run_calls(
        asked,
        [
            tools.Tool("shout", native=lambda text: F.concat(text, F.lit("!"))),
            tools.Tool("reverse", tools.each(lambda t: t[::-1])),
            tools.Tool("length", picky_length, "n_chars int, head string"),
        ],
        ["conv_id", "turn"],
    )
    return made.select(
        "conv_id", "turn", "position", "tool_call_id", "name", F.md5("content").alias("content_md5"), "error"
    )


# -- streams, files and the flagship ------------------------------------------


def _stream_to_table(spark, stream, label):
    """Run a stream to its end and read back what it wrote."""
    path = scratch_path(spark, label)
    query = monitor.append(stream, path, f"{path}-progress")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _arrivals(spark, rows, column, label, kind="parquet", parts=3):
    """Rows that arrive in some lots, by a column: the folder, again after each lot."""
    path = scratch_path(spark, label)
    least, most = rows.agg(F.min(column), F.max(column)).first()
    if least is None:
        rows.write.format(kind).save(path)
        yield path
        return
    lot = F.least(F.lit(parts - 1), F.floor((F.col(column) - least) * parts / (most - least + 1)))
    for part in range(parts):
        rows.filter(lot == part).write.mode("append").format(kind).save(path)
        yield path


def _monitored(spark, rows, column, label, keys=None):
    """Events seen by the monitor in three runs, each of which goes on from the last."""
    out = scratch_path(spark, label)
    for path in _arrivals(spark, rows, column, f"{label}-in"):
        stream = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", 1 << 30).parquet(path)
        monitor.monitor(stream, out, f"{out}-progress", keys=keys, idle_hours=24 * 365).awaitTermination()
    return monitor.read_results(spark, out)


def stream_last_messages(spark, sf_dir):
    turns = views.turns(spark, sf_dir)
    none = F.lit(None).cast("string")
    events = turns.select(
        "conv_id",
        F.col("role").alias("from_account"),
        none.alias("to_account"),
        F.timestamp_seconds("turn").alias("event_time"),
        F.col("turn").alias("msg_seq"),
        F.lit("after").alias("kind"),
        "text",
        F.lit(None).cast("double").alias("rating"),
        none.alias("reasoning"),
        none.alias("advice"),
    )
    rows = _monitored(spark, events, "msg_seq", "stream-history", ["conv_id"])
    return rows.filter(F.col("last_messages").isNotNull()).select(
        "conv_id",
        F.col("msg_seq").alias("turn"),
        F.size("last_messages").alias("n"),
        F.array_join("last_messages", "\n").alias("snippet"),
    )


def stream_notices(spark, sf_dir):
    events = views.chat_events(spark, sf_dir).select(
        "from_account", "to_account", F.timestamp_seconds("event_id").alias("event_time"),
        F.col("event_id").alias("msg_seq"), "kind", "text", "rating", "reasoning", "advice",
    )
    rows = _monitored(spark, events, "msg_seq", "stream-notices")
    return rows.select(
        F.col("msg_seq").alias("event_id"),
        "kind",
        "tier",
        "notice",
        F.get("response.MsgBody", F.lit(0))["MsgContent"]["Text"].alias("message"),
    )


def stream_responses(spark, sf_dir):
    """Raw request bodies as a stream: accepted ones to the monitor, others refused."""
    requests = views.callback_requests(spark, sf_dir)
    out, bad = scratch_path(spark, "stream-responses"), scratch_path(spark, "stream-refused")
    more = "event_id bigint, rating double, reasoning string, advice string"
    for path in _arrivals(spark, requests, "event_id", "stream-requests", "json"):
        parsed = request_source.stream_callbacks(spark, path, more=more)
        checked = callbacks.routed(callbacks.validate(parsed, views.APP_ID))
        taken = callbacks.accepted(checked).select(
            "from_account", "to_account", F.timestamp_seconds("event_id").alias("event_time"),
            F.col("event_id").alias("msg_seq"), "kind", "text", "rating", "reasoning", "advice",
        )
        monitor.monitor(taken, out, f"{out}-progress", idle_hours=24 * 365).awaitTermination()
        refused = monitor.rejections(checked).select("event_id", "response")
        monitor.append(refused, bad, f"{bad}-progress").awaitTermination()
    answered = monitor.read_results(spark, out).select(F.col("msg_seq").alias("event_id"), "response")
    both = answered.unionByName(spark.read.schema(answered.schema).parquet(bad))
    code = F.col("response.ErrorCode")
    return both.select(
        "event_id",
        F.when(code == 0, 200).otherwise(400).alias("http_status"),
        F.col("response.ActionStatus").alias("action_status"),
        F.col("response.ErrorInfo").alias("error_info"),
        code.alias("error_code"),
        F.get("response.MsgBody", F.lit(0))["MsgContent"]["Text"].alias("new_text"),
    )


def rating_by_length(texts: list[str]) -> list[str]:
    return [json.dumps({"rating": len(t) % 5 + 1, "reasoning": "length", "advice": "look"}) for t in texts]


def monitor_alerts(spark, sf_dir):
    """Admin messages that follow from the monitor's own ratings of the last messages."""
    events = views.chat_events(spark, sf_dir).select(
        "from_account", "to_account", F.timestamp_seconds("event_id").alias("event_time"),
        F.col("event_id").alias("msg_seq"), "kind", "text", "rating", "reasoning", "advice",
    )
    out = scratch_path(spark, "monitor-alerts")
    for path in _arrivals(spark, events, "msg_seq", "monitor-alerts-in"):
        stream = spark.readStream.schema(events.schema).parquet(path)
        monitor.monitor(
            stream, out, f"{out}-progress", rating_by_length, idle_hours=24 * 365, nonce=F.col("msg_seq")
        ).awaitTermination()
    return monitor.read_alerts(spark, out).select(F.col("msg_seq").alias("event_id"), "payload")


def stream_datasets_scored(spark, sf_dir):
    """Documents that arrive as CSV datasets in three lots, scored from kept replies."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    source, out = scratch_path(spark, "datasets-in"), scratch_path(spark, "datasets-scored")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = ((most or 0) - (least or 0)) // 3 + 1
    for lot in range(3):
        some = docs.filter(F.floor((F.col("doc_id") - F.lit(least)) / step) == lot)
        some.write.mode("append").options(header="true", **records.CELLS).csv(source)
        files_ = stream_datasets.stream_datasets(spark, source, files_per_batch=100)
        stream_datasets.score_stream(
            files_, length_scorer, "length", out, f"{out}-progress", f"{out}-replies"
        ).awaitTermination()
    rows = stream_datasets.read_results(spark, out)
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "model", F.col("rating").cast("double").alias("rating"),
        F.md5("content").alias("content_md5"),
    )


def stream_eval_summary(spark, sf_dir):
    """All metrics per sheet from counts that three lots of rated rows have added to."""
    items = views.table(spark, sf_dir, "lineitem")
    rows = views.rated(spark, sf_dir, items, "l_orderkey")
    counts = scratch_path(spark, "stream-counts")
    for path in _arrivals(spark, rows, "l_orderkey", "stream-rated"):
        stream = spark.readStream.schema(rows.schema).parquet(path)
        counters.evaluate_stream(stream, counts, f"{counts}-progress", ["sheet"]).awaitTermination()
    kinds = StructType([rows.schema["sheet"]])
    return rounded(metrics.summary(counters.counters_of(spark, counts, kinds), ["sheet"]))


def stream_alerts(spark, sf_dir):
    raw = views.table_stream(spark, sf_dir, "events")
    events = views.chat_events(spark, sf_dir, raw)
    rows = callbacks.alerts(events, nonce=F.col("event_id")).select("event_id", "payload")
    return _stream_to_table(spark, rows, "stream-alerts")


def scored_dataset_files(spark, sf_dir):
    """Documents written as scored datasets and read back, counted per dataset."""
    docs = views.table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("source").alias("dataset"),
        F.lit("rules").alias("model"),
        F.col("text").alias("content"),
        (F.col("n_chars") % 5 + 1).alias("rating"),
    )
    path = scratch_path(spark, "scored")
    writers.write_scored(rows, path)
    back = datasets.read_scored(spark, path)
    return back.groupBy("dataset", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rating").alias("ratings"),
        F.sum(F.length("content")).alias("chars"),
    )


def result_files(spark, sf_dir):
    """Rated documents written as result files, read back from a writer that was cut off."""
    docs = views.table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "result-files")
    rated = docs.select(
        F.col("source").alias("sheet"), F.col("doc_id").alias("position"), F.col("text").alias("content"),
        (F.col("n_chars") % 6).cast("double").alias("rating"),
    )
    results.stage_results(rated, folder, "m.1")
    back = datasets.read_model_output(spark, folder, "m.1")
    return back.select(
        "sheet", "model", F.md5("content").alias("content_md5"), "rating",
        F.length("content").alias("n_chars"),
    )


def dataset_source(spark, sf_dir):
    """Documents written as one CSV dataset, read by name and counted."""
    docs = views.table(spark, sf_dir, "documents")
    path = scratch_path(spark, "dataset")
    rating = F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") % 5 + 1)
    rows = docs.select("lang", F.col("text").alias("content"), rating.alias("rating"))
    rows.write.options(**datasets.CSV_OPTIONS).csv(path)
    back = datasets.read_datasets(spark, [path])
    return back.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count("rating").alias("n_rated"),
        F.sum(F.length("content")).alias("chars"),
    )


def csv_documents(spark, sf_dir):
    """Documents written as CSV with line breaks in cells, read back by byte ranges."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "csv-documents")
    docs.write.options(header="true", **records.CELLS).csv(path)
    back = records.read_table(spark, [path])
    return back.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang",
        F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"),
    )


def label_sheet_source(spark, sf_dir):
    """Label sheets written per sheet and read back."""
    path = scratch_path(spark, "sheets")
    views.sheet_labels(spark, sf_dir).write.partitionBy("sheet").parquet(path)
    return rounded(sheets.read_sheets(spark, path))


def page_source(spark, sf_dir):
    """Pages written as a store and read as page records."""
    path = scratch_path(spark, "pages")
    views.table(spark, sf_dir, "pages").select("url", "html").write.parquet(path)
    rows = page_store.read_pages(spark, path)
    return rows.select("url", "title", "status", "method", F.length("content").alias("n_chars"))


def scored_labels_evaluated(spark, sf_dir):
    """Datasets scored, written, read back, put beside their labels and measured."""
    docs = views.table(spark, sf_dir, "documents")
    position = F.col("doc_id").alias("position")
    scored = docs.select(
        F.col("source").alias("dataset"), F.lit("rules").alias("model"), position,
        F.col("text").alias("content"), (F.col("n_chars") % 6).cast("double").alias("rating"),
    )
    path = scratch_path(spark, "scored")
    writers.write_scored(scored, path)
    ratings = datasets.read_scored(spark, path).withColumnRenamed("dataset", "sheet")
    human = docs.select(
        F.col("source").alias("sheet"), position, F.col("text").alias("content"),
        (F.col("doc_id") % 11 / 2).alias("rating"),
    )
    merged = labels.merge_sheets(human, ratings)
    by_sheet = metrics.matrix(metrics.clean(merged), ["sheet"])
    return rounded(metrics.with_mae(by_sheet).select("sheet", "mae"))


def label_sheets_merged(spark, sf_dir):
    """Label sheets and ratings zipped, written as CSV, read back and evaluated."""
    ratings = views.sheet_ratings(spark, sf_dir)
    zipped = labels.merge_sheets(views.sheet_labels(spark, sf_dir), ratings)
    path = scratch_path(spark, "merged")
    writers.write_merged_labels(zipped, path)
    return metrics.clean_counts(datasets.read_ratings(spark, path))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per action tier: last three turns, rule verdict, tier."""
    snippets = history.last_messages(views.turns(spark, sf_dir), ["conv_id"], "turn", who="role")
    rows = scoring.with_notice(
        scoring.rule_verdict(snippets, "snippet", terms=views.PROSE_TERMS, signs=views.PROSE_SIGNS)
    )
    return rows.groupBy("rating", "tier").agg(F.count(F.lit(1)).alias("n")).orderBy("rating")


def conversation_tiers(spark, sf_dir):
    return flagship(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        labels_scan_by_sheet, eval_clean, clean_counts, rating_distribution, confusion_matrix,
        confusion_norm, qwk, qwk_band, mae, f1_macro_weighted, high_risk_pr, low_risk_rates,
        binary_f1, cost_error, error_direction, level_report, level_pred_dist, dist_compare,
        error_hist, level_accuracy, eval_summary, eval_summary_by_sheet, eval_verdicts,
        metrics_json, dataset_counts, label_zip, callback_parse, first_text, callback_validate,
        callback_reject_reasons, callback_route_counts, conv_key, action_tier, advice_tier,
        alert_payload, notice_injection, notice_injection_global, callback_response,
        callback_alerts, last3_messages, last3_chat_events, last3_one_chat, chat_messages,
        url_extract, url_extract_full, url_maximal, page_text, page_title, url_page_join, page_store_join, page_fallback, evidence_doc,
        verdict_parse, reply_content, risk_keywords, terms_tagged, fraud_type, rule_rating, link_rating,
        score_batch, replies_kept, score_conversations, workflow_result, workflow_ratings, conversation_tiers,
        stream_last_messages, stream_notices, stream_responses, stream_alerts, monitor_alerts,
        stream_datasets_scored, stream_eval_summary, workflow_records, tool_calls,
        scored_dataset_files, rubric_verdict, dataset_source, csv_documents, result_files, label_sheet_source, page_source,
        scored_labels_evaluated, label_sheets_merged,
    )
}
