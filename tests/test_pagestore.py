"""A bucketed page store gives what the page table gives, and reads less."""

import re

import pytest
from pyspark.sql import functions as F

from msgrisk import files
from msgrisk.operators import pages
from msgrisk.sources import pagestore


def pages_of(spark, rows):
    return pages.page_records(spark.createDataFrame(rows, "url string, html string"), "store")


def keys_of(spark, some):
    return spark.createDataFrame([(k,) for k in some], "key string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def found(df):
    return {r["key"]: (r["page"]["content"], r["page"]["status"]) for r in df.collect()}


@pytest.mark.parametrize("few", [1000, 2])
def test_newest_success_counts(spark, tmp_path, few):
    path = str(tmp_path / "store's")
    first = [("http://a.com/", "<p>a1</p>"), ("https://b.com/x", "<p>b1</p>"), ("c.com", "<p>c1</p>"), (None, "x"),
             ("http://A.com", "<p>a0</p>"), ("d.com", None)]
    assert pagestore.add_pages(pages_of(spark, first), path, buckets=16) == 0
    assert pagestore.add_pages(pages_of(spark, [("b.com/x", "<p>b2</p>"), ("c.com", None), ("e.com", "<p>e</p>")]), path) == 1
    wanted = ["a.com", "b.com/x", "c.com", "d.com", "none.com", "a.com", None]
    got = found(pagestore.wanted_pages(keys_of(spark, wanted), path, few))
    assert {k: v[0] for k, v in got.items()} == {"a.com": "a0", "b.com/x": "b2", "c.com": "c1", "d.com": None}
    assert got["d.com"][1] == "error" and got["c.com"][1] == "success"
    assert pagestore.wanted_pages(keys_of(spark, []), path, few).count() == 0
    assert pagestore.every_page(spark, path).count() == 7


def test_a_cut_off_version_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    pagestore.add_pages(pages_of(spark, [("a.com", "<p>old</p>")]), path, buckets=4)

    def fails(*args):
        raise OSError("lost")

    real, calls = files.write_text, []
    with monkeypatch.context() as lost:  # after the rows have been written
        lost.setattr(files, "write_text", lambda *a: fails() if calls else calls.append(real(*a)))
        with pytest.raises(OSError):
            pagestore.add_pages(pages_of(spark, [("a.com", "<p>half</p>")]), path)
    assert found(pagestore.wanted_pages(keys_of(spark, ["a.com"]), path))["a.com"][0] == "old"
    assert pagestore.add_pages(pages_of(spark, [("b.com", "<p>b</p>")]), path) == 2
    assert found(pagestore.wanted_pages(keys_of(spark, ["a.com"]), path))["a.com"][0] == "old"


def test_pages_are_pruned_or_stay_where_they_are(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(4000).select(
        F.concat(F.lit("http://h"), F.col("id") % 500, F.lit(".com/"), F.col("id")).alias("url"),
        F.concat(F.lit("<p>"), "id", F.lit("</p>")).alias("html"))
    pagestore.add_pages(pages.page_records(rows, "store"), path, buckets=32)
    few = pagestore.wanted_pages(keys_of(spark, ["h1.com/1", "h2.com/2"]), path)
    selected = re.search(r"SelectedBucketsCount: (\d+) out of 32", plan(few))
    assert selected and int(selected[1]) <= 2
    assert found(few) == {"h1.com/1": ("1", "success"), "h2.com/2": ("2", "success")}
    keys = rows.select(pages.urls.url_key(F.col("url")).alias("key")).filter("key LIKE '%1'")
    many = pagestore.wanted_pages(keys, path, few=10)
    assert many.count() == keys.count()
    text = plan(many)
    # One exchange for the distinct keys and one to the buckets; none above the scan of pages.
    scan = [i for i, line in enumerate(text.splitlines()) if "FileScan parquet" in line and "status" in line]
    above = text.splitlines()[: scan[0]][::-1]
    joined = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:joined])
