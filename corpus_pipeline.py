"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.llm import classify, dedup, packing, quality, simhash, toxicity
from msgrisk.llm.common import stored
from msgrisk.llm.queries import WORD_VOCABULARY, table
from msgrisk.session import tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    tune(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    names = {"score": "__toxic_score", "predicted": "__toxic"}
    judged = classify.scored(docs, model, toxicity.extractor, **names)
    return judged.where(F.col("__toxic") == 0).drop(*names.values())


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    tune(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    names = {"score": "__quality_score", "predicted": "__quality"}
    judged = classify.scored(docs, model, quality.extractor, **names)
    return judged.where(F.col("__quality") == 1).drop(*names.values())


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    tune(spark)
    return dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of fingerprints within the operator's bit distance the document with the smallest id."""
    tune(spark)
    return simhash.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document with its place."""
    tune(spark)
    rows = packing.pieces(docs, public_tokenizers.path(WORD_VOCABULARY))
    return packing.packed(rows).withColumnRenamed("id", "doc_id").drop("row")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

# The classifiers, fingerprints and token ids have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
