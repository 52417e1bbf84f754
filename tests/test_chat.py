"""Callbacks, history and notices, with large keys cut into pieces."""

import json
import random

import pytest
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.operators import callbacks, history, notices, splitting

EVENT = "key string, seq long, kind string, who string, text string, rating double"


def random_events(n, seed, hot=0.4, hot_key="hot"):
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(n * 50), n):
        key = hot_key if rng.random() < hot else f"k{rng.randrange(20)}"
        kind = rng.choice(["before", "after", "after"])
        rating = None if rng.random() < 0.1 else float(rng.randint(1, 5))
        text = rng.choice([None, "", f"t{seq}", f"t{seq}"])
        rows.append((key, seq, kind, rng.choice("xy"), text, rating))
    return rows


def history_model(rows, count):
    """The last lines per key, by a plain walk over the events."""
    kept, result = {}, {}
    for key, seq, _, who, text, _ in sorted(rows, key=lambda r: r[1]):
        if text is None:
            continue
        opening = key not in kept
        lines = kept.setdefault(key, [])
        if text == "" and opening:
            continue
        lines.append(f"{who}: {text}")
        result[(key, seq)] = lines[-count:]
    return result


def notice_model(rows, one_state=False):
    """The state machine of the alert level, by a plain walk over the events."""
    level, notice, shown = {}, {}, {}
    for key, seq, kind, _, _, rating in sorted(rows, key=lambda r: r[1]):
        key = 0 if one_state else key
        if kind == "after" and rating is not None:
            level[key] = rating
            if rating >= 3:
                notice[key] = f"---\n注意：r{seq}\n可疑程度：{int(rating)}\n建议：a\n---"
        elif kind == "before" and level.get(key, 0) >= 3:
            shown[seq] = notice[key]
            level[key] = 0
    return shown


LIMITS = [None, 1_000_000, 50, 20]


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("count,hot_key", [(1, "hot"), (3, "hot"), (3, None)])
def test_last_messages_match_a_walk(spark, limit, count, hot_key):
    rows = random_events(1500, seed=count, hot_key=hot_key)
    df = spark.createDataFrame(rows, EVENT)
    got = history.last_messages(df, ["key"], "seq", count=count, rows_per_task=limit).collect()
    assert {(r["key"], r["seq"]): r["last_messages"] for r in got} == history_model(rows, count)
    assert all(r["snippet"] == "\n".join(r["last_messages"]) for r in got)


def test_an_empty_opening_of_a_large_key_is_left_out(spark):
    rows = [("hot", s, "after", "x", "" if s in (0, 3) else "t", None) for s in range(40)]
    df = spark.createDataFrame(rows, EVENT)
    for limit in LIMITS:
        got = history.last_messages(df, ["key"], "seq", rows_per_task=limit).collect()
        assert {(r["key"], r["seq"]): r["last_messages"] for r in got} == history_model(rows, 3)


def test_count_must_be_positive(spark):
    df = spark.createDataFrame([], EVENT)
    with pytest.raises(ValueError):
        history.last_messages(df, ["key"], "seq", count=0)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("scope", ["conversation", "global"])
def test_notices_match_a_walk(spark, limit, scope):
    rows = random_events(1500, seed=11)
    df = spark.createDataFrame(rows, EVENT).withColumns(
        {"reasoning": F.concat(F.lit("r"), "seq"), "advice": F.lit("a")}
    )
    got = notices.inject_notices(df, ["key"], "seq", scope, rows_per_task=limit).collect()
    assert len(got) == len(rows)
    shown = {r["seq"]: r["notice"] for r in got if r["notice"] is not None}
    assert shown == notice_model(rows, scope == "global")


def test_a_notice_is_shown_once(spark):
    rows = [("k", 1, "after", "x", "t", 4.0), ("k", 2, "before", "y", "t", None),
            ("k", 3, "before", "y", "t", None)]
    df = spark.createDataFrame(rows, EVENT).withColumns(
        {"reasoning": F.lit("r"), "advice": F.lit("a")}
    )
    got = notices.inject_notices(df, ["key"], "seq").orderBy("seq").collect()
    assert [r["notice"] is not None for r in got] == [False, True, False]


@pytest.mark.parametrize("limit", LIMITS)
def test_positions_of_large_keys(spark, limit):
    rows = random_events(2000, seed=3, hot_key=None)
    df = spark.createDataFrame(rows, EVENT)
    got = splitting.numbered(df, ["key"], "seq", "n", rows_per_task=limit).collect()
    position, expected = {}, {}
    for key, seq, *_ in sorted(rows, key=lambda r: r[1]):
        position[key] = position.get(key, 0) + 1
        expected[(key, seq)] = position[key]
    assert {(r["key"], r["seq"]): r["n"] for r in got} == expected


def test_pieces_of_a_large_key_are_even(spark):
    df = spark.createDataFrame(random_events(4000, seed=5), EVENT)
    pieces = splitting.cut(df, ["key"], "seq", rows_per_task=100)
    sizes = [
        r["n"]
        for r in pieces.rows.filter("key = 'hot'").groupBy("_piece").agg(F.count("*").alias("n")).collect()
    ]
    assert len(sizes) > 10 and max(sizes) < 250


# -- callbacks --------------------------------------------------------------------


def request(app="app", platform="Web", body=None):
    if isinstance(body, dict):
        body = json.dumps(body)
    return (app, "c", platform, body)


GOOD = {"From_Account": "b", "To_Account": "a", "MsgSeq": 1, "MsgTime": 1557481126,
        "EventTime": 1670574414123,
        "MsgBody": [{"MsgType": "TIMTextElem", "MsgContent": {"Text": "hi"}}]}


def test_first_failed_check_wins(spark):
    rows = [
        request(None, None), request("", "Web", GOOD), request("x", "Bad", GOOD),
        request("app", None, GOOD), request("app", "Bad", GOOD), request("app", "iOS", None),
        request("app", "iOS", "{ }"), request("app", "iOS", "{broken"),
        request("app", "iOS", '{"a":1} tail'), request("app", "iOS", GOOD),
    ]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i int, SdkAppid string, CallbackCommand string, OptPlatform string, body string",
    )
    checked = callbacks.validate(callbacks.parse(df), "app").orderBy("i")
    got = [r["error_info"] for r in checked.collect()]
    assert got == [
        rubric.REJECT_NO_APP, rubric.REJECT_NO_APP, rubric.REJECT_BAD_APP,
        rubric.REJECT_PLATFORM, rubric.REJECT_PLATFORM, rubric.REJECT_BODY,
        rubric.REJECT_BODY, rubric.REJECT_BODY, rubric.REJECT_BODY, None,
    ]
    ok = callbacks.keyed(callbacks.accepted(checked)).collect()
    assert [(r["text"], r["conversation"], r["msg_seq"]) for r in ok] == [("hi", "a-b", 1)]
    assert callbacks.rejected(checked).count() == 9


def test_missing_account_is_rejected(spark):
    body = {k: v for k, v in GOOD.items() if k != "From_Account"}
    df = spark.createDataFrame(
        [request(body=body)],
        "SdkAppid string, CallbackCommand string, OptPlatform string, body string",
    )
    checked = callbacks.validate(callbacks.parse(df), "app")
    assert callbacks.accepted(checked).count() == 0
    assert callbacks.rejected(checked).count() == 1


def test_alert_payload(spark):
    df = spark.createDataFrame(
        [("after", "u", "v", 4.0, "r", "a"), ("after", "u", "v", 3.0, "r", "a"),
         ("before", "u", "v", 5.0, "r", "a")],
        "kind string, from_account string, to_account string, rating double, "
        "reasoning string, advice string",
    )
    got = callbacks.alerts(df).collect()
    assert len(got) == 1
    payload = json.loads(got[0]["payload"])
    assert payload["To_Account"] == "v" and payload["ForbidCallbackControl"] == rubric.ALERT_FORBID
    text = payload["MsgBody"][0]["MsgContent"]["Text"]
    assert text.startswith("管理员提醒：你在和u的聊天中") and "可疑程度：4" in text
    assert 1 <= payload["MsgRandom"] <= 10_000_000


def test_response_with_notice(spark):
    df = spark.createDataFrame(
        [(None, "n", "t"), (None, None, "t"), ("bad", "n", "t"), (None, "n", None)],
        "error_info string, notice string, text string",
    )
    got = callbacks.respond(df).collect()
    new = [r["response"]["MsgBody"] and r["response"]["MsgBody"][0]["MsgContent"]["Text"] for r in got]
    assert new == ["n\nt", None, None, "n\nNone"]
    assert [r["response"]["ErrorCode"] for r in got] == [0, 0, -1, 0]
    assert [r["http_status"] for r in got] == [200, 200, 400, 200]


def test_chat_messages_with_tool_calls(spark):
    rows = [
        (1, 2, "assistant", "", [("id1", "fetch", {"url": "u"})], None),
        (1, 1, "Human", "hi", None, None),
        (1, 3, "tool", "page", None, "id1"),
        (1, 4, "other", "x", None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "c int, turn int, role string, text string, "
        "tool_calls array<struct<id:string,name:string,args:map<string,string>>>, "
        "tool_call_id string",
    )
    each = history.chat_messages(df).orderBy("turn").collect()
    assert [r["message"]["content"] for r in each] == ["hi", "", "page"]
    got = history.requests(df, ["c"], "turn", 20).orderBy("turn").collect()
    assert [len(r["messages"]) for r in got] == [1, 2, 3]
    last = got[-1]["messages"]
    assert [(m["role"], m["content"]) for m in last] == [
        ("user", "hi"), ("assistant", ""), ("tool", "page"),
    ]
    call = last[1]["tool_calls"][0]
    assert call["type"] == "function" and json.loads(call["function"]["arguments"]) == {"url": "u"}
    assert last[2]["tool_call_id"] == "id1"


def test_chat_requests_of_a_large_conversation(spark):
    rows = [(1, t, "user", f"t{t}", [("i", "n", {"k": "v"})]) for t in range(300)]
    df = spark.createDataFrame(
        rows,
        "c int, turn int, role string, text string, "
        "tool_calls array<struct<id:string,name:string,args:map<string,string>>>",
    )
    got = history.requests(df, ["c"], "turn", 5, rows_per_task=20).collect()
    assert len(got) == 300
    for r in got:
        expected = [f"t{t}" for t in range(max(0, r["turn"] - 4), r["turn"] + 1)]
        assert [m["content"] for m in r["messages"]] == expected
