"""Scorers, the workflow, page joins and skewed keys."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions import verdicts
from msgrisk.operators import pages, scoring, workflow

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    """Fails on the first calls for a text, then answers."""

    def __init__(self, failures):
        self.failures, self.calls = failures, {}

    def __call__(self, texts):
        replies = []
        for text in texts:
            self.calls[text] = self.calls.get(text, 0) + 1
            good = self.calls[text] > self.failures.get(text, 0)
            replies.append('{"rating": 4}' if good else "not ready")
        return replies


def test_only_failed_items_are_retried():
    scorer = Flaky({"b": 1, "c": 2, "d": 3})
    got = scoring.score_texts(["a", "b", "c", "d"], scorer)
    assert [attempts for _, attempts, _ in got] == [1, 2, 3, 3]
    assert scorer.calls == {"a": 1, "b": 2, "c": 3, "d": 3}
    assert scoring.readable_rating(got[2][0]) and not scoring.readable_rating(got[3][0])


def test_one_failing_item_does_not_spoil_a_batch():
    def scorer(texts):
        if "bad" in texts:
            raise RuntimeError("boom")
        return ['{"rating": 2}' for _ in texts]

    got = scoring.score_texts(["a", "bad", "c"], scorer)
    assert got[0] == ('{"rating": 2}', 1, None) and got[1] == (None, 3, "boom")


REPLIES = {
    "bare": '{"rating": 4, "risk_keywords": ["x"]}', "fenced": '```json\n{"rating": 3}\n```',
    "prose": 'well {"rating": 3.5} yes', "none": "no", "reversed": "} {", "text": '{"rating": "4"}',
    "list": '{"rating": [4]}', "zero": '{"rating": 0}', "seven": '{"rating": 7}',
    "missing": '{"advice": "x"}',
}


def canned(texts):
    table = {
        "bare": '{"rating": 4, "risk_keywords": ["x"]}', "fenced": '```json\n{"rating": 3}\n```',
        "prose": 'well {"rating": 3.5} yes', "none": "no", "reversed": "} {",
        "text": '{"rating": "4"}', "list": '{"rating": [4]}', "zero": '{"rating": 0}',
        "seven": '{"rating": 7}', "missing": '{"advice": "x"}',
    }
    return [table[t] for t in texts]


def test_python_and_native_agree_on_ratings(spark):
    df = spark.createDataFrame([(r,) for r in REPLIES.values()], "reply string")
    got = df.select("reply", (verdicts.verdict_rating(F.col("reply")) > 0).alias("ok")).collect()
    assert all(scoring.readable_rating(r["reply"]) == r["ok"] for r in got)


@pytest.mark.parametrize("distinct", [True, False])
def test_score_batch(spark, distinct):
    rows = [(i, k) for i, k in enumerate([*REPLIES, "bare", "bare", None, ""])]
    df = spark.createDataFrame(rows, "i int, content string").withColumn("rating", F.lit(9.0))
    got = scoring.score_batch(df, canned, distinct=distinct).orderBy("i").collect()
    assert [r["rating"] for r in got] == [
        4.0, 3.0, 3.5, 0.0, 0.0, 0.0, 0.0, 0.0, 7.0, 0.0, 4.0, 4.0, 0.0, 0.0,
    ]
    assert got[0]["verdict"]["risk_keywords"] == ["x"]
    assert [r["attempts"] for r in got][:4] == [1, 1, 1, 3] and got[-1]["attempts"] == 0


def test_distinct_calls_each_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(len(texts))
        return ['{"rating": 1}'] * len(texts)

    df = spark.createDataFrame([("same",)] * 500 + [("other",)], "content string")
    assert scoring.score_batch(df, counting).count() == 501
    scoring.score_batch(df, counting).write.format("noop").mode("overwrite").save()
    assert calls.value == 2  # the count above needs no scores at all


def test_failed_conversation_gets_an_error_record(spark):
    def boom(texts):
        raise RuntimeError("boom")

    df = spark.createDataFrame([("a: b",)], "snippet string")
    got = scoring.score_conversations(df, boom).first()
    assert (got["error"], got["error_message"], got["verdict"]) == ("agent_failure", "boom", None)

    def fine(texts):
        body = {"rating": 3, "fraud_type": "t", "advice": "a", "risk_keywords": ["k"]}
        return ["```json\n" + json.dumps(body) + "\n```"] * len(texts)

    got = scoring.score_conversations(df, fine).first()
    assert got["error"] is None and got["verdict"]["rating"] == 3
    assert got["verdict"]["risk_keywords"] == ["k"]


def test_rule_verdict_levels(spark):
    texts = ["今天吃饭吗", "我是客服", "请打开屏幕共享", "冻结账户，配合调查，客服",
             "公安局：把保证金转入安全账户"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = scoring.with_notice(scoring.rule_verdict(df)).orderBy("i").collect()
    assert [r["rating"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["tier"] for r in got] == ["none", "none", "notice", "alert", "alert"]
    assert got[4]["advice"] == rubric.ADVICE["high"]


# -- pages and workflow -----------------------------------------------------------


def page_table(spark, rows):
    return spark.createDataFrame(rows, "url string, html string")


def test_source_order_and_failures(spark):
    one = pages.page_records(page_table(spark, [("a.com", "<p>one</p>"), ("b.com", None)]), "one")
    two = pages.page_records(
        page_table(spark, [("a.com", "<p>two</p>"), ("b.com", "<p>two</p>"), ("c.com", None)]), "two"
    )
    best = {r["key"]: r["page"] for r in pages.resolve_sources([one, two]).collect()}
    assert best["a.com"]["content"] == "one" and best["b.com"]["method"] == "two"
    assert best["c.com"]["status"] == "error" and best["c.com"]["error"] == rubric.UNKNOWN_ERROR


@pytest.fixture
def skew_settings(spark):
    """Thresholds so low that the small tables here count as skewed."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_link_is_split_over_tasks(spark, skew_settings):
    """One link in a third of all messages: the adaptive skew join splits it."""
    messages = spark.range(6000, numPartitions=8).select(
        F.col("id").alias("msg_id"),
        F.array(
            F.when(F.col("id") % 3 == 0, "https://hot.com").otherwise(
                F.concat(F.lit("https://x"), "id", F.lit(".com"))
            )
        ).alias("urls"),
    )
    store = pages.resolve_sources(
        [pages.page_records(page_table(spark, [("hot.com", "<p>hot</p>")]), "m")]
    )
    joined = pages.link_pages(messages, store)
    rows = joined.collect()
    assert sum(r["content"] == "hot" for r in rows) == 2000 and len(rows) == 6000
    assert "skew=true" in final_plan(joined)


def test_a_hot_text_is_split_over_tasks(spark, skew_settings):
    """One text in a third of all rows: scored once, joined back in parts."""
    df = spark.range(6000, numPartitions=8).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("content"),
    )
    scored = scoring.score_batch(df, lambda texts: [f'{{"rating": {len(t)}}}' for t in texts])
    rows = scored.collect()
    assert len(rows) == 6000 and sum(r["rating"] == 3 for r in rows) >= 2000
    assert "skew=true" in final_plan(scored)


def analyst(texts):
    if any("refuse" in t for t in texts):
        raise RuntimeError("no")
    return ["looks odd" for _ in texts]


def judge(texts):
    return ["" if "silent" in t else '{"rating": 3}' for t in texts]


def test_workflow_statuses_and_steps(spark):
    messages = spark.createDataFrame(
        [(1, "see a.com now"), (2, "no link"), (3, "refuse a.com"), (4, "silent b.com")],
        "msg_id int, text string",
    )
    store = pages.resolve_sources(
        [pages.page_records(page_table(spark, [("a.com", "<title>T</title><p>x</p>")]), "m")]
    )
    got = {r["msg_id"]: r for r in workflow.analyze(messages, store, analyst, judge).collect()}
    steps = {k: [s["step"] for s in r["workflow_steps"]] for k, r in got.items()}
    assert steps == {1: [1, 2, 3, 4], 2: [1, 2, 4], 3: [], 4: [1, 2, 3]}
    assert [got[k]["status"] for k in (1, 2, 3, 4)] == [
        "completed", "completed", "failed", "partial_failure",
    ]
    assert got[3]["error"] == "步骤1-初步分析失败: no" and got[3]["failed_step"] == 1
    assert got[4]["error"] == "步骤4-综合分析失败: 模型返回空结果" and got[4]["final_analysis"] == ""
    page = json.loads(got[1]["workflow_steps"][2]["result"])[0]
    assert page["url"] == "https://a.com" and page["title"] == "T" and page["content"] == "Tx"
    dead = json.loads(got[4]["workflow_steps"][2]["result"])[0]
    assert dead["status"] == "error" and dead["error"].startswith("访问失败")
    assert got[1]["timestamp"] is not None


def test_evidence_document(spark):
    messages = spark.createDataFrame([(1, "see b.com and a.com")], "msg_id int, text string")
    store = pages.resolve_sources([pages.page_records(page_table(spark, [("a.com", "<p>x</p>")]), "m")])
    seen = []

    rows = workflow.with_links(messages).transform(pages.attach_pages, store)
    rows = workflow.second_pass(workflow.first_pass(rows, analyst), judge)
    seen = rows.first()["evidence"]
    assert seen == (
        "\n原始文本：\nsee b.com and a.com\n\n初步分析：\nlooks odd\n\n网页内容分析：\n"
        "\nURL: https://a.com\n标题: 无标题\n内容摘要: x...\n"
        "\nURL: https://b.com\n访问状态: 失败 - 访问失败: https://b.com\n"
    )
