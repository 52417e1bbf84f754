"""State per key against a dictionary, over batches, merges, reruns and idle keys."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)
from test_streaming import EVENTS, write_part

from msgrisk import files
from msgrisk.streaming import monitor
from msgrisk.streaming.state import KeyedState

KEYS = StructType([StructField("a", StringType()), StructField("b", LongType())])
VALUES = StructType([
    StructField("n", LongType()), StructField("words", ArrayType(StringType())),
    StructField("seen", TimestampType()),
])


def state_of(spark, path, idle=10_000, buckets=5, width=3):
    return KeyedState(spark, str(path), KEYS, VALUES, "seen", timedelta(seconds=idle), buckets, width)


def rows_of(spark, some):
    """``{(a, b): (n, seconds)}`` as rows of state."""
    flat = [(a, b, n, t) for (a, b), (n, t) in some.items()]
    df = spark.createDataFrame(flat, "a string, b long, n long, t long")
    words = F.array_repeat("a", F.col("n").cast("int"))
    return df.select("a", "b", "n", words.alias("words"), F.timestamp_seconds("t").alias("seen"))


def read(df):
    return {(r["a"], r["b"]): (r["n"], r["t"]) for r in df.withColumn("t", F.unix_seconds("seen")).collect()}


def live(model, latest, idle):
    return {k: v for k, v in model.items() if v[1] >= latest - idle}


@pytest.mark.parametrize("idle", [10_000, 30])
def test_state_equals_a_dictionary(spark, tmp_path, idle):
    rng, model, latest = random.Random(idle), {}, 0
    for number in range(14):
        state = state_of(spark, tmp_path / "s", idle)  # a restart each time
        keys = [(rng.choice("abcdef"), rng.randrange(4)) for _ in range(rng.randrange(1, 7))]
        batch = spark.createDataFrame(keys, "a string, b long")
        assert read(state.before(number, batch)) == {k: v for k, v in model.items() if k in keys}
        new = {k: (rng.randrange(5), 10 * number + rng.randrange(10)) for k in keys}
        new = {k: (n, max(t, model.get(k, (0, 0))[1])) for k, (n, t) in new.items()}
        state.commit(number, rows_of(spark, new))
        latest = max([latest, *(t for _, t in new.values())])
        model = live(model | new, latest, idle)
        if number in (3, 9):  # the batch is run again, from the state before it
            assert state.before(number, batch).count() <= len(set(keys))
            state.commit(number, rows_of(spark, new))
        assert read(state.every()) == model
        manifest = state.manifest(number + 1)
        for runs in manifest.runs.values():
            levels = [level for level, _ in runs]
            assert all(levels.count(level) < 3 for level in levels)
    assert len(state.steps()) <= 2
    steps = {run[1] for n in state.steps() for runs in state.manifest(n + 1).runs.values() for run in runs}
    assert {int(n.split("=")[1]) for n in files.names(spark, f"{tmp_path}/s/runs")} == steps


def test_a_rerun_after_a_merge_finds_the_old_state(spark, tmp_path):
    state = state_of(spark, tmp_path / "s", buckets=1, width=2)
    for number in range(5):
        state.commit(number, rows_of(spark, {("x", number): (number, number)}))
    before = read(state.every(4))
    assert before == {("x", n): (n, n) for n in range(4)}
    for _ in range(2):  # batch 4 again: nothing it needs has been deleted
        state.commit(4, rows_of(spark, {("x", 0): (9, 4)}))
        assert read(state.every()) == before | {("x", 0): (9, 4)}
    assert read(state.every(4)) == before


def test_empty_batches_and_first_batch(spark, tmp_path):
    state = state_of(spark, tmp_path / "s")
    none = spark.createDataFrame([], "a string, b long")
    assert state.before(0, none).count() == 0 and state.every().count() == 0
    state.commit(0, spark.createDataFrame([], state.schema))
    assert state.every().count() == 0
    with pytest.raises(ValueError):
        state_of(spark, tmp_path / "t", width=1)


def test_what_is_written_follows_the_keys_of_a_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    many = [(f"c{i}", i, "after", "x", f"text of conversation {i}", None) for i in range(3000)]
    write_part(spark, many, source)
    few = [("c1", 9000, "after", "x", "again", None), ("c2", 9001, "after", "x", "again", None)]
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)

    def run():
        assert monitor.monitor(stream, out, out + "-p", idle_hours=1000).awaitTermination(120)

    run()
    write_part(spark, few, source)
    run()
    first, second = (files.size(spark, f"{out}/state/runs/step={n}") for n in (0, 1))
    assert 0 < second < first / 10
    assert len(files.names(spark, f"{out}/state/runs/step=1/level=0")) <= 3  # two buckets, _SUCCESS
    got = {r["msg_seq"]: r["last_messages"] for r in monitor.read_results(spark, out).collect()}
    assert got[9000] == ["a: text of conversation 1", "a: again"]


def test_scratch_of_a_batch_is_removed(spark, tmp_path, monkeypatch):
    made = []
    real = monitor.scratch_path
    monkeypatch.setattr(monitor, "scratch_path", lambda *a: made.append(real(*a)) or made[-1])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_part(spark, [("p", 1, "after", "x", "hello", None)], source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    scorer = lambda texts: ['{"rating": 1}'] * len(texts)
    assert monitor.monitor(stream, out, out + "-p", scorer).awaitTermination(60)
    assert made and not any(files.size(spark, path) for path in made)
