"""Importance resampling against counting with dictionaries."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from msgrisk.llm import queries, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + pairs]


def brute(docs, target, least=20, share=25):
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(f for *_, fs in found for f in fs), Counter(f for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
        for b in range(10_000)
    ]
    rows, order = [], []
    for i, n, fs in found:
        weight = sum(gain[f] for f in fs) // len(fs) if fs else 0
        name = "null" if i is None else i
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, None])
        if n >= least:
            order.append((-score, i is None, i or 0, len(rows) - 1))
    for rank, (*_, at) in enumerate(sorted(order)[: share * len(order) // 100], 1):
        rows[at][4] = rank
    return rows


def as_rows(frame):
    return [[r["id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in frame.collect()]


def test_query_equals_brute_force(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = queries.op12_resampling(spark, sf_dir)
    want = brute(pairs, [r["text"] for r in target.collect()])
    assert sorted(as_rows(found.withColumnRenamed("doc_id", "id"))) == sorted(want)
    assert sum(r[4] is not None for r in want) > 5


@pytest.mark.parametrize("empty_target", [False, True])
def test_odd_rows(spark, tmp_path, empty_target):
    long = "Many WORDS äÖ of one text, 12.5 " * 20_000
    texts = [None, "", " \t", "--", "a", "Ab_c9 É x\x00y", "w" * 200_000, long, long]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    rows += [(None, "null id " * 30, "y", 2), (3, "same words here " * 10, "z", 3)]
    rows += [(100, "copies of a text with words " * 5, "z", i) for i in range(9)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, score string, part int").write.parquet(path)
    docs = spark.read.parquet(path)
    target = spark.createDataFrame([("words of one text",), (None,)], "text string")
    if empty_target:
        target = target.limit(0)
    ranks = resampling.resampled(docs, target, share=60)
    want = brute([r[:2] for r in rows], [] if empty_target else ["words of one text"], share=60)
    assert sorted(map(repr, as_rows(ranks))) == sorted(map(repr, want))
    drawn = resampling.drawn(docs, ranks)
    assert drawn.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"]) for r in drawn.collect())
    assert texts == Counter(rows[at][:2] for at, r in enumerate(want) if r[4] is not None)
    assert resampling.resampled(docs.limit(0), target).count() == 0


def test_drawn_rows_lean_to_the_target(spark, sf_dir):
    """Documents made of target words are drawn more often than their share."""
    rows = [(i, ("alpha beta gamma " if i % 5 == 0 else "one two three ") * 10) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("alpha beta gamma alpha beta",)] * 50, "text string")
    found = resampling.resampled(docs, target, share=20).where("rank IS NOT NULL").collect()
    assert len(found) == 100 and sum(r["id"] % 5 == 0 for r in found) > 60
