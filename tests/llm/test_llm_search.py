"""URL rules and top-k search against brute force."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from msgrisk.llm import topk, urlfilter


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path


def verdict_of(url, rules):
    host, path = parts_of(url)
    fits = [
        (len(h + p), v == "block", h + p, v) for v, h, p in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls(spark):
    dice = random.Random(5)
    rules = list(urlfilter.RULES) + [
        ("block", "a.b.org", ""), ("allow", "b.org", "/x"), ("block", "b.org", "/x"), ("block", "b.org", "/x/y"),
        ("allow", "a.b.org", "/x/"),
    ]
    urls = [None, "", "no scheme", "http://", "https://ORG", "http://É.org/a", "x://a.b.org?q=://c.com/de/",
            "http://.org/", "http://b.org/x", "http://org./x", "http://" + "a." * 300 + "org/" + "x/" * 3000]
    for _ in range(600):
        host = ".".join(dice.choice("abc") for _ in range(dice.randint(0, 3)))
        host = f"{host}.{dice.choice(['org', 'b.org', 'example.org', 'com', 'xorg', 'net'])}".lstrip(".")
        path = dice.choice(["", "/", "/x", "/x/y", "/x/", "/es/1", "/en/12", "/en/2", "/fr/", "/de/?a", "#/de/"])
        urls.append(f"{dice.choice(['http', 'HTTPS'])}://{host}{path}")
    urls += ["http://hot.org/x"] * 500
    rows = [(i % 900 or None, u, "mine") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = urlfilter.judged(pages, urlfilter.rules_table(spark, rules)).collect()
    want = [(i, *verdict_of(u, rules)) for i, u, _ in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert urlfilter.judged(pages.limit(0), urlfilter.rules_table(spark)).count() == 0
    none = urlfilter.judged(pages, urlfilter.rules_table(spark).limit(0))
    assert none.where("verdict = 'allow' AND rule IS NULL").count() == len(rows)


def test_very_long_urls(spark):
    hosts = ["a." * 50_000 + "org", "x" * 100_000 + ".com", "b." * 50_000 + "example.org", "y" * 100_000]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/fr/" + "p/" * 50_000, "/es/" + "q" * 100_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    start = time.time()
    found = urlfilter.judged(pages, urlfilter.rules_table(spark)).collect()
    assert time.time() - start < 30
    want = [(i, *verdict_of(u, urlfilter.RULES)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, found)) == want


def best_of(rows, ask, k):
    numbers = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            numbers.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in (q for q in numbers if ask(q)):
        asked = min(numbers[q])
        scores = [
            (-sum(a * b for a, b in zip(asked, v)), i) for i, vs in numbers.items() if i != q for v in vs
        ]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,boxes", [(16, 64 << 20), (16, 300), (8192, 64 << 20)])
def test_top_k(spark, monkeypatch, shard, boxes):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BOXES", boxes)
    monkeypatch.setattr(topk, "LEAF", 4)
    dice = random.Random(4)
    rows = [(i, [dice.choice([-1.5, 0.25, 3.0]) + dice.random() for _ in range(4)]) for i in range(300)]
    rows += [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(300, 360)]  # copies and ties
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4),
             (None, [9.0] * 4), (7, [2.0] * 4), (10, [2.0] * 4), (404, [5.0]), (405, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = topk.top_k(frame, F.col("vec_id") % 10 == 0).collect()
    floats = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert sorted(map(tuple, found)) == best_of(floats, lambda i: i % 10 == 0, 5)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e6 + i, -1e6 + 3 * i]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("vec_id") < 3).collect()
    assert sorted(map(tuple, found)) == best_of(rows, lambda i: i < 3, 5)
