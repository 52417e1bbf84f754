"""CSV files cut at arbitrary bytes against a reader of whole files."""

import csv
import io
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from msgrisk.sources import datasets, records


@contextmanager
def small_ranges(spark, size):
    settings = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 1}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def written(rows, names, end="\n", quoting=csv.QUOTE_MINIMAL, last=True):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=end, quoting=quoting)
    writer.writerows([names, *rows])
    text = out.getvalue()
    return text if last else text.removesuffix(end)


def cells(rng, alphabet):
    long = rng.random() < 0.05
    text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(400) if long else rng.randrange(12)))
    return text.strip(" ") or "x"


ALPHABETS = {"utf-8": 'ab,"\n\n"你é ', "gbk": 'ab,"\n你好界 ', "latin-1": 'ab,"\n\xe9\xff\xe4'}


@pytest.mark.parametrize("size", [500, 1 << 20])
def test_ranges_equal_the_whole_file(spark, tmp_path, size):
    rng, want = random.Random(size), {}
    for charset, alphabet in ALPHABETS.items():
        for i, (end, last) in enumerate([("\n", True), ("\r\n", False)]):
            names = ["content", "note"] if i else ["note", "content", "rating"]
            rows = [[cells(rng, alphabet) for _ in names] for _ in range(150)]
            rows[7] = ["é" if charset == "latin-1" else "你", *rows[7][1:]]
            data = written(rows, names, end, last=last).encode(charset)
            if charset == "utf-8" and i:
                data = b"\xef\xbb\xbf\n\n" + data
            (tmp_path / f"dataset-{charset}{i}.csv").write_bytes(data)
            for at, row in enumerate(rows):
                want[f"dataset-{charset}{i}", at] = dict(zip(names, row))
    with small_ranges(spark, size):
        got = datasets.read_datasets(spark, [str(tmp_path / "*.csv")])
        if size == 500:
            assert records._lines(spark, [str(tmp_path)]).rdd.getNumPartitions() > 50
        found = {(r["dataset"], r["position"]): r for r in got.collect()}
    assert found.keys() == want.keys()
    for key, row in want.items():
        assert found[key]["content"] == row["content"] and found[key]["note"] == row["note"]


def test_one_cell_over_many_ranges_and_blank_lines(spark, tmp_path):
    long = "line with, commas\n" * 200 + 'and "quotes"\n\n'
    text = '\n\nid,content\n1,"' + long.replace('"', '""') + '"\n\n2,short\n  \n3,""\n4,\n'
    (tmp_path / "dataset-a.csv").write_text(text)
    (tmp_path / "dataset-empty.csv").write_text("")
    with small_ranges(spark, 100):
        got = datasets.read_datasets(spark, [str(tmp_path / "*.csv")]).orderBy("position").collect()
    assert [(r["id"], r["content"] or "") for r in got] == [("1", long), ("2", "short"), ("3", ""), ("4", "")]
    with pytest.raises(ValueError):
        datasets.read_datasets(spark, [str(tmp_path / "dataset-empty.csv")])


def test_a_quote_that_never_closes(spark, tmp_path):
    (tmp_path / "dataset-a.csv").write_text('id,content\n1,a\n2,"open\n3,b\n4,c\n')
    with small_ranges(spark, 8):
        got = datasets.read_datasets(spark, [str(tmp_path / "*.csv")]).orderBy("position").collect()
    assert got[0]["content"] == "a" and len(got) == 2 and got[1]["id"] == "2"


def test_headers_of_many_kinds_give_one_scan(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"dataset-{i}.csv").write_text(f"content,c{i},content\nx,{i},y\n")
    got = records.read_table(spark, [str(tmp_path)], {"path": F.col("file")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "hashpartitioning(file_id" not in plan
    rows = got.collect()
    assert len(rows) == 30 and {r["content0"] for r in rows} == {"x"} and {r["content2"] for r in rows} == {"y"}
    assert sorted(int(r[f"c{i}"]) for i in range(30) for r in rows if r[f"c{i}"] is not None) == list(range(30))
