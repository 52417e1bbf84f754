"""Operator 6: exact deduplication by a tree of merged digest runs (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import of_key, row_key, stored

WAYS = 64  # runs that are merged into one in each round


def normalised(text: Column) -> Column:
    """White space as single spaces; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def proof(text: Column) -> Column:
    """What verifies that texts of the same digest are the same."""
    return F.struct(F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("hash"))


def digest_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One light row per document: its digest, what verifies it, and its first run.

    A first run is what one input partition holds. The rows are to be written before
    use, so that a repeated task cannot deal them out anew.
    """
    text = docs.select(
        F.col(id_column).alias("id"), normalised(F.col(text_column)).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    return text.select(
        "id", "row",
        digest(F.col("text")).alias("digest"),
        proof(F.col("text")).alias("proof"),
        F.spark_partition_id().alias("run"),
    )


def merge_rounds(runs: DataFrame) -> list[DataFrame]:
    """The levels of the tree, from the first runs to one run.

    In each round the runs whose numbers differ in their last base-64 digit only go to
    the first of them: a binomial tree of radix 64. They are exchanged by digest, so a
    run lies on many tasks, and each task sorts what it gets and merges equal
    digests in one sweep (``SortAggregate``), after the sender has merged its own. A
    level has one row for each digest and run: the smallest identifier and the
    number of rows so far. The proof is part of the key, so rows whose digests
    agree but whose texts do not would stay apart at every level.
    """
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    levels = [
        runs.groupBy("digest", "proof", "run").agg(F.min(first).alias("first"), F.count("*").alias("size"))
    ]
    width = (runs.agg(F.max("run")).first()[0] or 0) + 1
    while width > 1:
        width = -(-width // WAYS)
        levels.append(
            levels[-1]
            .withColumn("run", (F.col("run") / WAYS).cast("int"))
            .groupBy("digest", "proof", "run")
            .agg(F.min("first").alias("first"), F.sum("size").alias("size"))
        )
    return levels


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: ``id, row, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after each stretch of white space
    became one space; null is the empty text. The row with the smallest id stays;
    null ids count as larger than all others, and of rows that share text and id
    one stays (``kept``). ``keep_id`` is null only where no row of a group has an id.
    ``row`` tells the result's rows apart, no more. Other columns are ignored, whatever
    their names. An empty table gives an empty result.

    Text is read once and stays where it is; what moves is a digest per row. Each
    input partition is a run, merged where it is read before it is exchanged, and the
    result goes back down the same tree, so no task sees all rows of one text.
    """
    runs = stored(digest_runs(docs, id_column, text_column), "digest-runs")
    levels = merge_rounds(runs)
    root = levels[-1].select("digest", "proof", "first", "size", F.col("run").alias("parent"))
    for level in reversed(levels[:-1]):
        own = level.select("digest", "proof", "run", (F.col("run") / WAYS).cast("int").alias("parent"))
        root = own.join(root, ["digest", "proof", "parent"]).select(
            "digest", "proof", "first", "size", F.col("run").alias("parent")
        )
    found = runs.withColumnRenamed("run", "parent").join(root, ["digest", "proof", "parent"])
    return found.select(
        "id",
        "row",
        F.col("first.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("first.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are known by their id and digest, which a second look at the text gives
    again. Of rows that share both, one stays: copies are combined where they are
    read, before texts are moved.
    """
    kept = exact_groups(docs, id_column, text_column).where("kept")
    kept = kept.select(row_key(F.col("id"), F.col("text_sha256")))
    digests = F.sha2(normalised(F.col(text_column)), 256)
    return of_key(docs, row_key(F.col(id_column), digests), kept)
