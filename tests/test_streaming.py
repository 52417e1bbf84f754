"""Streams give what the batch operators give, across batches and restarts."""

import json

import pytest
from pyspark.sql import functions as F
from test_chat import history_model, notice_model, random_events

from msgrisk.operators import callbacks as ops
from msgrisk.operators import splitting
from msgrisk.sources import callbacks
from msgrisk.streaming import datasets, monitor

EVENTS = (
    "from_account string, to_account string, event_time timestamp, msg_seq bigint, kind string, "
    "text string, rating double, reasoning string, advice string"
)


def write_part(spark, rows, path):
    """One file of events; the account pair stands for the key of a row."""
    df = spark.createDataFrame(
        rows, "key string, seq long, kind string, who string, text string, rating double"
    )
    df.select(
        F.when(F.col("who") == "x", F.lit("a")).otherwise("zz").alias("from_account"),
        F.concat(F.lit("k-"), "key").alias("to_account"),
        F.timestamp_seconds("seq").alias("event_time"),
        F.col("seq").alias("msg_seq"),
        "kind",
        "text",
        "rating",
        F.concat(F.lit("r"), "seq").alias("reasoning"),
        F.lit("a").alias("advice"),
    ).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, scorer=None):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    query = monitor.monitor(stream, out, out + "-progress", scorer, idle_hours=1000)
    assert query.awaitTermination(180)
    return monitor.read_results(spark, out)


@pytest.mark.parametrize("cut", [False, True])
def test_stream_equals_a_walk_over_batches_and_a_restart(spark, tmp_path, monkeypatch, cut):
    if cut:  # the hot conversation is cut into pieces in each micro-batch
        monkeypatch.setattr(splitting, "TABLE_BYTES", 0)
        monkeypatch.setattr(splitting, "ROWS", 15)
    rows = [r for r in random_events(600, seed=21)]
    rows = [(k, s, kind, "x", t, rating) for k, s, kind, _, t, rating in rows]
    rows.sort(key=lambda r: r[1])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_part(spark, rows[:200], source)
    write_part(spark, rows[200:400], source)
    run(spark, source, out)
    write_part(spark, rows[400:], source)  # the second run goes on from the checkpoint
    got = run(spark, source, out).collect()
    assert len(got) == len(rows)
    after = [r for r in rows if r[2] == "after"]
    lines = {
        (k, s): [x.replace("x: ", "a: ", 1) for x in v]
        for (k, s), v in history_model(after, 3).items()
    }
    found = {(r["to_account"][2:], r["msg_seq"]): r["last_messages"] for r in got
             if r["last_messages"] is not None}
    assert found == lines
    assert {r["msg_seq"]: r["notice"] for r in got if r["notice"]} == notice_model(rows)


def test_stream_with_a_scorer(spark, tmp_path):
    def scorer(texts):
        return [
            "unreadable" if "broken" in t
            else json.dumps({"rating": 4 if "money" in t else 1, "reasoning": "r", "advice": "a"})
            for t in texts
        ]

    rows = [("p", 1, "after", "x", "hello", None), ("p", 2, "after", "x", "send money", None),
            ("p", 3, "before", "x", "ok", None), ("p", 4, "before", "x", "ok", None),
            ("q", 5, "after", "x", "broken", None), ("q", 6, "before", "x", "ok", None)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_part(spark, rows, source)
    table = run(spark, source, out, scorer)
    got = table.orderBy("msg_seq").collect()
    assert [r["rating"] for r in got] == [1, 4, None, None, None, None]
    assert [r["tier"] for r in got][:2] == ["none", "alert"]
    texts = [r["response"]["MsgBody"] and r["response"]["MsgBody"][0]["MsgContent"]["Text"] for r in got]
    assert texts[2].endswith("---\nok") and texts[3] is None and texts[5] is None
    assert all(r["error"] is None for r in got)
    sent = monitor.alerts(table).collect()
    assert len(sent) == 1 and json.loads(sent[0]["payload"])["To_Account"] == "k-p"


def test_a_failing_scorer_leaves_an_error_record(spark, tmp_path):
    def scorer(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("down")
        return ['{"rating": 5, "reasoning": "r", "advice": "a"}'] * len(texts)

    rows = [("p", 1, "after", "x", "boom", None), ("q", 2, "after", "x", "fine", None),
            ("p", 3, "before", "x", "ok", None)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_part(spark, rows, source)
    got = run(spark, source, out, scorer).orderBy("msg_seq").collect()
    assert [(r["rating"], r["error"], r["error_message"]) for r in got] == [
        (None, "agent_failure", "down"), (5, None, None), (None, None, None),
    ]
    assert got[2]["notice"] is None


def test_callback_stream(spark, tmp_path):
    body = {"From_Account": "b", "To_Account": "a", "MsgSeq": 1, "EventTime": 1670574414123,
            "MsgBody": [{"MsgType": "TIMTextElem", "MsgContent": {"Text": "hi"}}]}
    lines = [
        {"SdkAppid": app, "CallbackCommand": "C2C.CallbackAfterSendMsg", "OptPlatform": "Web",
         "body": json.dumps(body)} for app in ("app", "bad")
    ]
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(map(json.dumps, lines)))
    checked = ops.routed(ops.validate(callbacks.stream_callbacks(spark, str(folder)), "app"))
    events = ops.accepted(checked).select(
        "from_account", "to_account", "event_time", "msg_seq", "kind", "text",
        F.lit(5.0).alias("rating"), F.lit("r").alias("reasoning"), F.lit("a").alias("advice"),
    )
    out = str(tmp_path / "out")
    assert monitor.monitor(events, out, out + "-p").awaitTermination(60)
    assert monitor.read_results(spark, out).first()["last_messages"] == ["b: hi"]
    refused = monitor.rejections(checked).select("response")
    bad = str(tmp_path / "bad")
    assert monitor.append(refused, bad, bad + "-p").awaitTermination(60)
    assert [r["response"]["ErrorInfo"] for r in spark.read.parquet(bad).collect()] == ["Invalid SdkAppid"]


def test_idle_conversations_are_forgotten(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_part(spark, [("p", 1, "after", "x", "old", None), ("q", 2, "after", "x", "old", None)], source)
    write_part(spark, [("q", 7000, "after", "x", "new", None)], source)
    write_part(spark, [("p", 7001, "after", "x", "again", None), ("q", 7002, "after", "x", "end", None)], source)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    assert monitor.monitor(stream, out, out + "-p", idle_hours=1).awaitTermination(120)
    got = {r["msg_seq"]: r["last_messages"] for r in monitor.read_results(spark, out).collect()}
    assert got[7000] == ["a: old", "a: new"] and got[7001] == ["a: again"]
    assert got[7002] == ["a: old", "a: new", "a: end"]


def test_datasets_are_scored_as_they_arrive(spark, tmp_path):
    def scorer(texts):
        return [f'{{"rating": {len(t)}}}' for t in texts]

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "dataset-a.csv").write_text('id,content,rating\n77,"x\ny",\n78,ab,\n')

    def score():
        stream = datasets.stream_datasets(spark, str(source), files_per_batch=1)
        query = datasets.score_stream(stream, scorer, "m", out, out + "-progress")
        assert query.awaitTermination(60)
        rows = datasets.read_results(spark, out).collect()
        return sorted((r["dataset"], r["content"], float(r["rating"])) for r in rows)

    first = [("dataset-a", "ab", 2.0), ("dataset-a", "x\ny", 3.0)]
    assert score() == first
    (source / "dataset-b.csv").write_bytes("rating,content,note\n,你好吗呢,备注\n".encode("gbk"))
    assert score() == [*first, ("dataset-b", "你好吗呢", 4.0)]
    assert score() == [*first, ("dataset-b", "你好吗呢", 4.0)]
    rows = {r["content"]: r for r in datasets.read_results(spark, out).collect()}
    assert rows["ab"]["id"] == "78" and rows["你好吗呢"]["note"] == "备注"
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_alerts_follow_from_the_monitors_ratings(spark, tmp_path):
    def scorer(texts):
        return [json.dumps({"rating": 5 if "money" in t else 1, "reasoning": "r", "advice": "a"}) for t in texts]

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sent = []
    for lot, text in enumerate(["money", "hello", "more money"]):
        write_part(spark, [(f"k{lot}", lot, "after", "x", text, None)], source)
        run(spark, source, out, scorer)
        if lot == 0:
            delivered = str(tmp_path / "delivered")
        stream = monitor.stream_alerts(spark, out).select("to_account", "payload")
        assert monitor.append(stream, delivered, delivered + "-p").awaitTermination(60)
        sent = spark.read.parquet(delivered).collect()
    assert sorted(r["to_account"] for r in sent) == ["k-k0", "k-k2"]
    kept = {r["payload"] for r in monitor.read_alerts(spark, out).collect()}
    assert kept == {r["payload"] for r in sent} and len(kept) == 2
