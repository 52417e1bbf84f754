"""Operator 12: importance resampling towards the n-gram distribution of target texts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from msgrisk.llm.common import column, grown, in_ranges, map_rows, row_key, shrunk, stored

BUCKETS = 10_000
LONGEST = 2  # words of the longest feature
LEAST_WORDS = 20  # of a document that can be drawn
SHARE = 25  # per cent of those that are drawn
SEED = 7

# Bytes of words: digits, letters a-z and all that is not ASCII; A-Z become a-z.
LETTERS = bytes(range(256)).lower()
PLAIN = bytes(
    LETTERS[b] if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in range(256)
)
GAPS = regex.compile(rb" {2,}")


def span_patterns(longest: int) -> list:
    """One pattern per n: n words between single spaces, from one word's start on."""
    return [
        regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))
        for n in range(1, longest + 1)
    ]


def features(text: bytes, patterns: list, buckets: int) -> list[np.ndarray]:
    """Bucket numbers of a text's features, one array per length of feature.

    Separators become single spaces, so a feature is a span of the text as it stands.
    The scans overlap: a match begins at each word, and the spans are counted as they
    come, without a list of words.
    """
    line = GAPS.sub(b" ", text.translate(PLAIN))
    crc = zlib.crc32
    return [
        np.fromiter((crc(m[0]) for m in p.finditer(line, overlapped=True)), np.uint32) % buckets
        for p in patterns
    ]


def bucket_lists(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS,
) -> DataFrame:
    """``(id, digest, n_words, n_features, buckets)``: the sorted bucket of each feature.

    ``buckets`` are the steps from each number to the next, compressed.
    """
    schema = StructType([
        StructField("id", docs.schema[id_column].dataType), StructField("digest", BinaryType()),
        StructField("n_words", LongType()), StructField("n_features", LongType()),
        StructField("buckets", BinaryType()),
    ])

    def make():
        patterns = span_patterns(longest)

        def work(batch):
            out = {n: [] for n in ("n_words", "n_features", "buckets")}
            for text in column(batch, "text"):
                found = features(text or b"", patterns, buckets)
                numbers = np.sort(np.concatenate(found))
                out["n_words"].append(len(found[0]))
                out["n_features"].append(len(numbers))
                out["buckets"].append(shrunk(np.diff(numbers.astype(np.int64), prepend=0)))
            yield out | {n: batch.column(batch.schema.get_field_index(n)) for n in ("id", "digest")}

        return work

    rows = docs.select(
        F.col(id_column).alias("id"), _digest(F.col(text_column)).alias("digest"),
        F.col(text_column).cast("binary").alias("text"),
    )
    return map_rows(rows, make, schema, 500)


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def bucket_numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for n, data in zip(column(batch, "n_features"), column(batch, "buckets")):
        yield np.cumsum(grown(data, n))


def bucket_counts(lists: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds: summed up by each task, then over them.

    The result has one number per bucket, whatever the table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for numbers in bucket_numbers(batch):
                total += np.bincount(numbers, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": held.astype(np.int32), "n": total[held]})

    partial = lists.select("n_features", "buckets").mapInArrow(count, "bucket int, n long")
    found = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored 1000-fold log of its share in the target over the source's."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
            for s, t in pairs
        ],
        np.int64,
    )


def weights(lists: DataFrame, gain: np.ndarray) -> DataFrame:
    """The lists with ``weight``, the floored mean of the gains of a text's features."""
    kept = ("id", "digest", "n_words", "n_features")
    schema = StructType([*(lists.schema[n] for n in kept), StructField("weight", LongType())])
    shared = lists.sparkSession.sparkContext.broadcast(gain)

    def make():
        def work(batch):
            found = []
            for numbers in bucket_numbers(batch):
                found.append(int(shared.value[numbers].sum()) // len(numbers) if len(numbers) else 0)
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in kept}
            yield columns | {"weight": found}

        return work

    return map_rows(lists, make, schema)


def noisy(weight, id_column, seed: int):
    """The weight plus Gumbel noise that depends on the seed and the id only."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, draw: int) -> DataFrame:
    """The first ``draw`` rows by score, ties by smaller id, with ``rank`` from 1 on.

    Rows are sorted over ranges; a range's first rank is the number of rows in the
    ranges before it, so no task sees more than its range.
    """
    turned = rows.withColumn("turned", -F.col("score")).withColumn("no_id", F.col("id").isNull())
    dealt = in_ranges(turned, ["turned", "no_id", "id", "digest", "row"], "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row per task
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = dealt.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at") + 1)
    return placed.where(F.col("rank") <= draw).drop("part", "at", "start", "turned", "no_id")


def resampled(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    target_column: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED,
) -> DataFrame:
    """``(id, digest, n_features, weight, score, rank)`` for each document.

    Features are the runs of 1 to ``longest`` words, in ``buckets`` by CRC; each bucket
    gains by how much likelier it is in the target texts than in the documents. Of the
    documents with ``least_words`` words, ``share`` per cent are drawn without
    replacement, likelier the higher their weight; ``rank`` is null for all others.

    Null texts count as empty: no features, weight 0, never drawn unless
    ``least_words`` is 0. A null id draws its noise as the name "null" and comes last
    among ties. Repeated rows count and are drawn each by itself. Other columns are
    ignored. Counts cover all rows and whole texts. Empty tables give an empty result,
    an empty target gives gains by the documents alone.
    """
    lists = stored(bucket_lists(docs, id_column, text_column, longest, buckets), "buckets")
    wanted = bucket_lists(target.select(F.lit(None).cast("long").alias("id"), F.col(target_column).alias("text")),
                          "id", "text", longest, buckets)
    gain = gains(bucket_counts(lists, buckets), bucket_counts(wanted, buckets))
    scored = weights(lists, gain).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored.withColumn("score", noisy(F.col("weight"), F.col("id"), seed)), "weights")
    able = scored.where(F.col("n_words") >= least_words)
    first = ranked(able, share * able.count() // 100)
    ranks = first.select("row", "rank")
    joined = scored.join(ranks, "row", "left")
    return joined.select("id", "digest", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, ranks: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns.

    Rows are known by id and text. Where several share both, as many come back as
    were drawn, each with the other columns of one of them.
    """
    name, times = "__key_of_row", "__times_drawn"
    key = row_key(F.col("id"), F.hex("digest"))
    often = ranks.where(F.col("rank").isNotNull()).groupBy(key.alias(name)).agg(F.count("*").alias(times))
    keyed = docs.withColumn(name, row_key(F.col(id_column), F.hex(_digest(F.col(text_column)))))
    found = keyed.dropDuplicates([name]).join(often, name)
    turn = F.explode(F.sequence(F.lit(1), F.col(times)))
    return found.withColumn(times, turn).select(*docs.columns)
