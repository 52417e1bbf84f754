"""CSV charsets, sheets, result files and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from msgrisk.operators import labels, metrics
from msgrisk.sinks import writers
from msgrisk.sources import callbacks, datasets, sheets
from msgrisk.sources import pages as page_source

ROWS = 'content,rating\n"你好\n世界 ""x""",1\nabc,\n'


def save(path, text, charset="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(charset))
    return str(path)


def test_each_file_is_read_in_its_charset(spark, tmp_path):
    files = [
        save(tmp_path / "dataset-一.csv", ROWS),
        save(tmp_path / "dataset-gbk.csv", ROWS, "gbk"),
        save(tmp_path / "dataset-latin.csv", 'content,rating\n"caf\xe9 \xff",2\n', "latin-1"),
        save(tmp_path / "dataset-bom.csv", "﻿" + ROWS),
    ]
    got = datasets.read_datasets(spark, [*files, str(tmp_path / "absent.csv")])
    rows = {}
    for r in got.orderBy("dataset", "position").collect():
        rows.setdefault(r["dataset"], []).append((r["content"], r["rating"]))
    both = [('你好\n世界 "x"', 1.0), ("abc", None)]
    assert rows == {
        "dataset-一": both, "dataset-gbk": both, "dataset-bom": both,
        "dataset-latin": [("caf\xe9 \xff", 2.0)],
    }


def test_no_dataset_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        datasets.read_datasets(spark, [str(tmp_path / "absent.csv")])
    with pytest.raises(ValueError):
        datasets.read_datasets(spark, [save(tmp_path / "x.csv", "a,b\n1,2\n")])


def test_null_marks(spark, tmp_path):
    path = save(
        tmp_path / "r.csv",
        "content,human rating,rating\na,1,2\nb,NaN,3\nc,,4\nd,2,N/A\ne,x,1\nf,1.5,nan\n",
    )
    got = [(r["human rating"], r["rating"]) for r in datasets.read_ratings(spark, path).collect()]
    assert got == [(1, 2), (None, 3), (None, 4), (2, None), (None, 1), (1.5, None)]


def test_model_output_names(spark, tmp_path):
    save(tmp_path / "dataset-客服_m.1_test.csv", "content,rating\na,3\nb,\n")
    save(tmp_path / "dataset-x_y_m.1_test.csv", "content,rating\nc,4\n")
    save(tmp_path / "dataset-x_other_test.csv", "content,rating\nd,5\n")
    got = datasets.read_model_output(spark, str(tmp_path), "m.1")
    rows = [(r["sheet"], r["content"], r["rating"]) for r in got.orderBy("sheet", "position").collect()]
    assert rows == [("x_y", "c", 4.0), ("客服", "a", 3.0), ("客服", "b", None)]
    every = datasets.read_model_output(spark, str(tmp_path)).select("model").distinct()
    assert {r[0] for r in every.collect()} == {"m.1", "other"}
    with pytest.raises(FileNotFoundError):
        datasets.read_model_output(spark, str(tmp_path), "absent")


def test_merge_and_write_labels(spark, tmp_path):
    for sheet, text in {"a": "content,rating\n\"x\ny\",1\nz,2\n", "b": "content,rating\nw,3\n"}.items():
        save(tmp_path / "labels" / f"sheet={sheet}" / "part.csv", text)
        save(tmp_path / "out" / f"dataset-{sheet}_m_test.csv", "content,rating\nq,5\n")
    left = sheets.read_sheets(spark, str(tmp_path / "labels"), "csv")
    right = datasets.read_model_output(spark, str(tmp_path / "out"), "m")
    merged = labels.merge_sheets(left, right)
    path = str(tmp_path / "merged")
    writers.write_merged_labels(merged, path)
    back = datasets.read_ratings(spark, path)
    got = sorted((r["content"], r["human rating"], r["rating"]) for r in back.collect())
    assert got == [("w", 3, 5), ("x\ny", 1, 5), ("z", 2, None)]
    record = str(tmp_path / "metrics")
    writers.write_metrics(metrics.clean(back), record)
    found = json.loads(spark.read.text(record).first()[0])
    assert found["total_samples"] == 2 and found["mae"] == 3 and "qwk" in found


def test_a_csv_sheet_is_one_file(spark, tmp_path):
    for name in ("1", "2"):
        save(tmp_path / "sheet=a" / f"{name}.csv", "content,rating\na,1\n")
    with pytest.raises(ValueError):
        sheets.read_sheets(spark, str(tmp_path), "csv")


def test_parquet_sheets_need_a_position(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x", 1.0)], "sheet string, position long, content string, rating double")
    df.write.partitionBy("sheet").parquet(str(tmp_path / "good"))
    assert sheets.read_sheets(spark, str(tmp_path / "good")).first()["sheet"] == "a"
    df.drop("position").write.partitionBy("sheet").parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        sheets.read_sheets(spark, str(tmp_path / "bad"))


def test_scored_round_trip(spark, tmp_path):
    rows = [("d1", "m", 'a "b"\nc', 3.0), ("d2", "m", "x,y", 0.0)]
    df = spark.createDataFrame(rows, "dataset string, model string, content string, rating double")
    writers.write_scored(df, str(tmp_path / "s"))
    got = datasets.read_scored(spark, str(tmp_path / "s"))
    assert sorted((r["dataset"], r["model"], r["content"], r["rating"]) for r in got.collect()) == rows


def test_callbacks_and_pages_from_files(spark, tmp_path):
    body = json.dumps({"From_Account": "b", "To_Account": "a", "EventTime": 1670574414123})
    line = json.dumps({"SdkAppid": "app", "CallbackCommand": "c", "OptPlatform": "Web", "body": body})
    save(tmp_path / "c" / "1.json", line + "\n")
    got = callbacks.read_callbacks(spark, str(tmp_path / "c")).first()
    assert got["from_account"] == "b" and got["event_time"].microsecond == 123000
    pages = spark.createDataFrame([("http://a.com/", "<p>x</p>")], "url string, html string")
    pages.write.parquet(str(tmp_path / "p"))
    assert page_source.read_pages(spark, str(tmp_path / "p")).first()["key"] == "a.com"
    replies = spark.createDataFrame([("a.com", '{"content":"c","status":"success"}'), ("b.com", "plain")],
                                    "url string, reply string")
    got = page_source.records_from_replies(replies).orderBy("key").collect()
    assert [(r["key"], r["content"], r["status"]) for r in got] == [
        ("a.com", "c", "success"), ("b.com", "plain", "success"),
    ]


def test_alert_and_workflow_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p",)], "payload string").withColumn("at", F.current_timestamp())
    writers.write_alerts(df, str(tmp_path / "a"))
    writers.write_alerts(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    writers.write_workflow_results(df, str(tmp_path / "w"))
    assert json.loads(spark.read.text(str(tmp_path / "w")).first()[0])["payload"] == "p"


def test_columns_go_by_name(spark, tmp_path):
    files = [save(tmp_path / "dataset-a.csv", "id,content,rating\n77,x,1\n"),
             save(tmp_path / "dataset-b.csv", "rating,content\n2,y\n")]
    got = datasets.read_datasets(spark, files, "content string, rating double, id int, extra int")
    rows = sorted((r["content"], r["rating"], r["id"], r["extra"]) for r in got.collect())
    assert rows == [("x", 1.0, 77, None), ("y", 2.0, None, None)]


def test_text_positions_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", str(i), "c", 1.0) for i in range(3)],
                                 "sheet string, position string, content string, rating double")
    with pytest.raises(ValueError):
        labels.zip_labels(rows, rows)
    numbers = rows.withColumn("position", F.col("position").cast("int")).withColumn("model", F.lit("m"))
    writers.write_scored(numbers.withColumnRenamed("sheet", "dataset"), str(tmp_path / "s"))
    assert dict(datasets.read_scored(spark, str(tmp_path / "s")).dtypes)["position"] == "bigint"
