"""Kept replies: no text is asked about twice, whatever cuts a job off."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from test_streaming import EVENTS, write_part

from msgrisk.operators import replies, scoring, workflow
from msgrisk.operators.pages import page_records, resolve_sources
from msgrisk.streaming import datasets, monitor


class Asked:
    """A scorer that notes what it is asked in a folder, across worker processes."""

    def __init__(self, folder, fails=()):
        folder, fails = str(folder), set(fails)
        os.makedirs(folder, exist_ok=True)

        def scorer(texts):
            if fails & set(texts):
                time.sleep(3)  # others end meanwhile
                raise SystemExit("the worker is lost")
            with open(f"{folder}/{os.getpid()}", "a") as file:
                file.writelines(json.dumps(t) + "\n" for t in texts)
            return [f'{{"rating": {len(t) % 5}}}' for t in texts]

        self.folder, self.scorer = folder, scorer

    def texts(self):
        found = []
        for name in os.listdir(self.folder):
            with open(f"{self.folder}/{name}") as file:
                found += map(json.loads, file)
        return found


def table(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")


def test_equals_batch_scoring(spark, tmp_path):
    def scorer(texts):
        if "bad" in texts:
            raise ValueError("down")
        return [None if t == "none" else f'{{"rating": {len(t)}}}' for t in texts]

    texts = ["a", "bb", "a", None, "", "bad", "none", "ccc", "a", "é" * 30_000]
    df = table(spark, texts)
    want = scoring.score_batch(df, scorer).orderBy("i").collect()
    got = replies.score_kept(df, scorer, str(tmp_path / "r"), "m").orderBy("i")
    assert got.columns == scoring.score_batch(df, scorer).columns
    names = ("i", "content", "rating", "attempts", "error")
    assert [[r[n] for n in names] for r in got.collect()] == [[r[n] for n in names] for r in want]
    empty = df.limit(0)
    assert replies.score_kept(empty, scorer, str(tmp_path / "none"), "m").count() == 0


def test_a_job_cut_off_asks_no_kept_text_again(spark, tmp_path):
    path, texts = str(tmp_path / "r"), [f"text {i}" for i in range(300)]
    first = Asked(tmp_path / "first", fails=["text 123"])
    with pytest.raises(Exception):  # noqa: B017
        replies.ask(table(spark, texts), first.scorer, path, "m", texts_per_task=5)
    kept = replies.read_replies(spark, path, "m").count()
    assert 0 < kept < 300
    second = Asked(tmp_path / "second")
    assert replies.ask(table(spark, texts), second.scorer, path, "m", texts_per_task=5) == 300 - kept
    assert len(second.texts()) == 300 - kept
    assert len(set(first.texts()) & set(second.texts())) <= 5 * 8  # the tasks under way
    third = Asked(tmp_path / "third")
    rows = replies.score_kept(table(spark, [*texts, "new", *texts]), third.scorer, path, "m")
    assert rows.where("rating = 0 AND length(content) % 5 <> 0").count() == 0
    assert third.texts() == ["new"] and rows.count() == 601


def test_many_tasks_run_as_several_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replies, "TASKS_PER_JOB", 4)
    monkeypatch.setattr(replies, "FEW_KEYS", 10)
    path, asked = str(tmp_path / "r"), Asked(tmp_path / "asked")
    df = table(spark, [f"text {i}" for i in range(100)] * 2)
    assert replies.ask(df, asked.scorer, path, "m", texts_per_task=7) == 100
    assert len(asked.texts()) == len(set(asked.texts())) == 100
    assert replies.score_kept(df, asked.scorer, path, "m").count() == 200
    assert len(asked.texts()) == 100


def test_models_and_failures(spark, tmp_path):
    path, df = str(tmp_path / "r"), table(spark, ["x", "yy"])

    def down(texts):
        raise RuntimeError("down")

    got = replies.score_kept(df, down, path, "a").orderBy("i").collect()
    assert [(r["rating"], r["attempts"], r["error"]) for r in got] == [(0.0, 3, "down")] * 2
    asked = Asked(tmp_path / "a")
    replies.ask(df, asked.scorer, path, "a")
    assert asked.texts() == []  # a failure is an answer
    assert replies.ask(df, asked.scorer, path, "a", again=True) == 2 and len(asked.texts()) == 2
    assert replies.ask(df, asked.scorer, path, "a", again=True) == 0
    got = replies.score_kept(df, down, path, "a").orderBy("i").collect()
    assert [(r["rating"], r["error"]) for r in got] == [(1.0, None), (2.0, None)]
    other = Asked(tmp_path / "b")
    replies.ask(df, other.scorer, path, "b")
    assert sorted(other.texts()) == ["x", "yy"]
    replies.merge_small(spark, path, str(tmp_path / "few"))
    assert replies.read_replies(spark, str(tmp_path / "few")).count() == 4


def test_workflow_and_monitor_keep_replies(spark, tmp_path):
    first, second = Asked(tmp_path / "one"), Asked(tmp_path / "two")
    messages = spark.createDataFrame([(1, "see a.com"), (2, "see a.com"), (3, ""), (4, None)], "msg_id int, text string")
    pages = resolve_sources([page_records(spark.createDataFrame([("a.com", "<p>x</p>")], "url string, html string"), "s")])
    args = (messages, pages, first.scorer, second.scorer)
    when = F.lit("2020-01-01").cast("timestamp")
    kept = str(tmp_path / "kept")
    plain = sorted(workflow.analyze(*args, timestamp=when).collect())
    asked = len(first.texts()), len(second.texts())
    for more in ((1, 2), (0, 0)):  # texts "see a.com" and ""; nothing the second time
        before = len(first.texts()), len(second.texts())
        got = workflow.analyze(*args, timestamp=when, kept=kept).orderBy("msg_id").collect()
        assert got == plain  # sorting repeats the plan, but no question
        assert len(first.texts()) - before[0] == (2 if more[0] else 0)
        assert len(second.texts()) - before[1] == (2 if more[1] else 0)
    assert asked == (3, 3)

    source, out, judge = str(tmp_path / "in"), str(tmp_path / "out"), Asked(tmp_path / "judge")
    write_part(spark, [("p", 1, "after", "x", "hello", None), ("p", 2, "after", "x", "bye", None)], source)
    for lost in ("", "-again"):
        stream = spark.readStream.schema(EVENTS).parquet(source)
        query = monitor.monitor(stream, out + lost, out + lost + "-p", judge.scorer, replies=kept)
        assert query.awaitTermination(60)
    assert len(judge.texts()) == 2  # two histories, each asked about once
    rows = [monitor.read_results(spark, out + lost).orderBy("msg_seq").collect() for lost in ("", "-again")]
    assert rows[0] == rows[1] and rows[0][0]["rating"] is not None


def test_stream_asks_once(spark, tmp_path):
    source, out, asked = tmp_path / "in", str(tmp_path / "out"), Asked(tmp_path / "asked")
    source.mkdir()
    (source / "dataset-a.csv").write_text("content\nab\nab\nabc\n")

    def run(checkpoint):
        stream = datasets.stream_datasets(spark, str(source), files_per_batch=1)
        query = datasets.score_stream(stream, asked.scorer, "m", out, checkpoint, str(tmp_path / "replies"))
        assert query.awaitTermination(60)

    run(out + "-p")
    (source / "dataset-b.csv").write_text("content\nabc\nabcd\n")
    run(out + "-p")
    run(out + "-lost-progress")  # all batches again, without a question
    assert sorted(asked.texts()) == ["ab", "abc", "abcd"]
    rows = datasets.read_results(spark, out).collect()
    assert sorted((r["content"], float(r["rating"])) for r in rows) == [
        ("ab", 2.0), ("ab", 2.0), ("abc", 3.0), ("abc", 3.0), ("abcd", 4.0),
    ]
