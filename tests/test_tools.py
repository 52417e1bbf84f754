"""Users' text tools: texts, records, failures, and the calls of chat messages."""

import pytest
from pyspark.sql import functions as F

from msgrisk.operators import tools


def texts(spark, some):
    return spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, text string")


def rows(df):
    return [(r["x"]["result"], r["x"]["error"], r["x"]["attempts"]) for r in df.orderBy("i").collect()]


def test_text_tool(spark):
    def shout(t):
        if t == "bad":
            raise ValueError("no")
        return None if t == "none" else t.upper()

    df = texts(spark, ["a", "bad", None, "", "none", "a"])
    tool = tools.Tool("shout", tools.each(shout), attempts=2)
    got = tools.with_tool(df, tool, "text", "x")
    assert got.columns == ["i", "text", "x"]
    assert rows(got) == [("A", None, 1), (None, "no", 2), (None, None, 0), ("", None, 1), (None, None, 2), ("A", None, 1)]
    assert rows(tools.with_tool(df.limit(0), tool, "text", "x")) == []


def test_record_tool(spark):
    replies = {"full": {"n": 1, "s": "x", "extra": 2}, "part": {"n": 3}, "text": "no record", "none": None}
    tool = tools.Tool("records", lambda some: [replies[t] for t in some], "n int, s string")
    got = rows(tools.with_tool(texts(spark, list(replies)), tool, "text", "x"))
    assert [r and (r["n"], r["s"]) for r, _, _ in got] == [(1, "x"), (3, None), None, None]
    assert [e for _, e, _ in got] == [None, None, tools.NO_RECORD, tools.NO_RECORD]


def test_native_tool_runs_no_python(spark):
    tool = tools.Tool("length", native=F.length)
    got = tools.with_tool(texts(spark, ["abc", None]), tool, "text", "x")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == [(3, None, 1), (None, None, 0)]
    for wrong in ({}, {"run": list, "native": F.length}):
        with pytest.raises(ValueError):
            tools.Tool("wrong", **wrong)


def test_calls_of_messages(spark):
    calls = [[("1", "double", {"text": "ab"}), ("2", "absent", {"text": "x"}), ("3", None, None)], [], None,
             [("4", "count", {"text": "abc"}), ("5", "double", {"other": "x"})]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(calls)],
                               "m int, tool_calls array<struct<id: string, name: string, args: map<string, string>>>")
    some = [tools.Tool("double", lambda t: [x * 2 for x in t]),
            tools.Tool("count", lambda t: [{"n": len(x)} for x in t], "n int, gone string")]
    got = tools.run_calls(df, some, ["m"]).orderBy("m", "position").collect()
    assert [(r["m"], r["tool_call_id"], r["name"], r["content"], r["error"]) for r in got] == [
        (0, "1", "double", "abab", None), (0, "2", "absent", None, tools.NO_TOOL), (0, "3", None, None, tools.NO_TOOL),
        (3, "4", "count", '{"n":3,"gone":null}', None), (3, "5", "double", None, None),
    ]
    with pytest.raises(ValueError):
        tools.run_calls(df, [some[0], some[0]], ["m"])
