"""Large keys are found and cut without being asked for; a global order is scanned."""

import random

import pytest
from pyspark.sql import functions as F
from test_chat import EVENT, history_model, notice_model, random_events

from msgrisk.operators import history, labels, notices, scans, splitting


@pytest.fixture
def tiny(monkeypatch):
    """Every table counts as large and 40 rows as many."""
    monkeypatch.setattr(splitting, "TABLE_BYTES", 0)
    monkeypatch.setattr(splitting, "ROWS", 40)


def events(spark, n, seed, hot_key="hot"):
    rows = random_events(n, seed=seed, hot_key=hot_key)
    df = spark.createDataFrame(rows, EVENT)
    return rows, df.withColumns({"reasoning": F.concat(F.lit("r"), "seq"), "advice": F.lit("a")})


def test_large_keys_are_found(spark):
    ids = spark.range(0, 30_000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, F.lit(None).cast("string"))
        .otherwise(F.col("id").cast("string")).alias("a"), (F.col("id") % 2).alias("b"))
    found = {(r["a"], r["b"]): r["n"] for r in splitting.large_keys(ids, ["a", "b"], 1000).collect()}
    want = {(r["a"], r["b"]): r["n"] for r in ids.groupBy("a", "b").agg(F.count("*").alias("n"))
            .filter("n > 1000").collect()}
    assert found == want and len(found) == 4
    assert splitting.large_keys(ids, ["a", "b"], 20_000).count() == 0
    assert splitting.large_keys(ids.limit(0), ["a"], 0).count() == 0


@pytest.mark.parametrize("hot_key", ["hot", None])
def test_results_with_large_keys_cut(spark, tiny, hot_key):
    rows, df = events(spark, 1500, 31, hot_key)
    got = history.last_messages(df, ["key"], "seq").collect()
    assert {(r["key"], r["seq"]): r["last_messages"] for r in got} == history_model(rows, 3)
    shown = notices.inject_notices(df, ["key"], "seq").collect()
    assert len(shown) == len(rows)
    assert {r["seq"]: r["notice"] for r in shown if r["notice"] is not None} == notice_model(rows)
    numbers = splitting.numbered(df, ["key"], "seq", "n").collect()
    seen = {}
    for r in sorted(numbers, key=lambda r: r["seq"]):
        seen[r["key"]] = seen.get(r["key"], 0) + 1
        assert r["n"] == seen[r["key"]]


def test_only_large_keys_are_cut_and_their_pieces_are_even(spark, tiny):
    _, df = events(spark, 4000, 5)
    pieces = splitting.cut(df, ["key"], "seq")
    sizes = pieces.rows.groupBy("key", "_piece").agg(F.count("*").alias("n")).collect()
    large = {r["key"] for r in splitting.large_keys(df, ["key"], 40).collect()}
    assert "hot" in large
    assert all((r["_piece"] == -1) == (r["key"] not in large) for r in sizes)
    assert max(r["n"] for r in sizes) <= 100 and sum(r["n"] for r in sizes) == df.count()


def test_small_tables_are_not_looked_through(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(splitting, "large_keys", None)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert splitting.cut(turns, ["conv_id"], "turn").edges is None


def test_zip_with_a_large_sheet(spark, tiny):
    human = spark.range(300).select(
        F.when(F.col("id") < 250, "big").otherwise("small").alias("sheet"), F.col("id").alias("position"),
        F.col("id").cast("string").alias("content"), F.col("id").cast("double").alias("rating"))
    model = human.withColumn("rating", F.col("rating") * 2)
    got = labels.zip_labels(human, model).collect()
    assert len(got) == 300 and all(r["rating"] == 2 * r["human rating"] for r in got)


@pytest.mark.parametrize("limit", [None, 1, 7, 1000])
def test_scan_equals_a_walk(spark, limit):
    rng = random.Random(limit)
    rows = [(None if i == 0 else i * 3, rng.choice([None, "a", "b" * 50]), rng.random() < 0.2) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "at int, text string, take boolean").repartition(3)
    got = scans.last_before(df, "at", F.upper("text"), F.col("take"), "before", limit)
    assert got.columns == ["at", "text", "take", "before"]
    found, last = {r["at"]: r["before"] for r in got.collect()}, None
    for at, text, take in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        assert found[at] == last
        if take:
            last = text and text.upper()
    assert scans.last_before(df.limit(0), "at", F.col("text"), F.col("take"), "before", limit).count() == 0
    none = scans.last_before(df, "at", F.col("text"), F.lit(None).cast("boolean"), "before", limit)
    assert none.filter("before IS NOT NULL").count() == 0
