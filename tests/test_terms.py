"""Lexicons as tables against the lexicon functions and plain search."""

import random
import time

import pytest
from pyspark.sql import functions as F

from msgrisk import rubric
from msgrisk.functions import lexicon
from msgrisk.operators import terms


def table_of(spark, groups, weights=None):
    rows = [(g, t, (weights or {}).get(g, 1), i) for i, (g, t) in enumerate(
        (g, t) for g, some in groups.items() for t in some)]
    return terms.lexicon_table(
        spark.createDataFrame(rows, "group string, term string, weight int, rank int"),
        weight="weight", rank="rank",
    )


def texts_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


@pytest.mark.parametrize("characters", [terms.CHARACTERS, 40])
def test_equals_the_lexicon_functions(spark, characters):
    rng, words = random.Random(5), [t for some in rubric.RISK_KEYWORDS.values() for t in some]
    texts = ["".join(rng.choice([*words, "x", " ", "银", "Σ", "İ"]) for _ in range(rng.randrange(9))) for _ in range(200)]
    df = texts_of(spark, [*texts, None, "", "".join(words).upper()])
    table = table_of(spark, rubric.RISK_KEYWORDS, rubric.GROUP_WEIGHTS)
    groups = lexicon.risk_keywords(F.col("text"))
    got = terms.with_terms(df, "text", table, characters=characters).select(
        "i",
        terms.terms_of(F.col("matches")).alias("a"), lexicon.all_keywords(groups).alias("b"),
        terms.weight_of(F.col("matches")).alias("c"), lexicon.risk_score(groups).alias("d"),
        *[terms.terms_in(F.col("matches"), g).alias(f"g{n}") for n, g in enumerate(rubric.RISK_KEYWORDS)],
        *[groups[g].alias(f"h{n}") for n, g in enumerate(rubric.RISK_KEYWORDS)],
    ).collect()
    assert len(got) == 203 and sum(len(r["a"]) > 1 for r in got) > 50
    for r in got:
        assert r["a"] == r["b"] and r["c"] == r["d"]
        assert all(r[f"g{n}"] == r[f"h{n}"] for n in range(len(rubric.RISK_KEYWORDS)))


def test_odd_terms(spark):
    rows = [("g", "Ab"), ("g", "ab"), ("h", "AB"), (None, "b"), ("g", ""), ("g", None), ("g", "Ab"), ("g", "😀x")]
    table = terms.lexicon_table(spark.createDataFrame(rows, "group string, term string"))
    df = texts_of(spark, ["xABx", "", None, "😀X b", "ab" * 100_000])
    got = terms.with_terms(df, "text", table).orderBy("i").collect()
    all_ab = [(None, "b"), ("g", ""), ("g", "Ab"), ("g", "ab"), ("h", "AB")]
    assert [[(m["group"], m["term"]) for m in r["matches"]] for r in got] == [
        all_ab, [("g", "")], [], [(None, "b"), ("g", ""), ("g", "😀x")], all_ab,
    ]
    assert got[0].__fields__ == ["i", "text", "matches"]
    lead = terms.leading_group(F.col("matches"))
    best = terms.with_terms(df, "text", table).select("i", lead.alias("l")).orderBy("i").collect()
    assert [(r["l"]["group"], r["l"]["hits"]) for r in best] == [
        ("g", 3), ("g", 1), (None, 0), ("g", 2), ("g", 3),
    ]
    none = table.filter("false")
    assert all(r["matches"] == [] for r in terms.with_terms(df, "text", none).collect())
    assert terms.with_terms(df.limit(0), "text", table).count() == 0


def test_ten_thousand_terms_cost_little_more_than_ten(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(8)
    rows = spark.range(10_000).select(F.lit("g").alias("group"), F.concat(F.lit("q"), F.hex("id"), F.lit("z")).alias("term"))
    many = terms.lexicon_table(rows)
    few = terms.lexicon_table(rows.limit(10))

    def seconds(table):
        found = terms.with_terms(docs, "text", table)
        found.count()
        start = time.time()
        found.write.format("noop").mode("overwrite").save()
        return time.time() - start, found._jdf.queryExecution().executedPlan().toString()

    (slow, large), (fast, small) = seconds(many), seconds(few)
    assert len(large) < len(small) + 200 and slow < 4 * fast + 3
