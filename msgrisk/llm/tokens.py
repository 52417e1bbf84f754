"""Operator 1: byte-pair encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from msgrisk.llm.bpe import ByteBpe, Part
from msgrisk.llm.common import column, map_rows

SPLIT = 32_768  # characters; longer texts are encoded by several tasks


@cache
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def _kind(frame: DataFrame, name: str):
    return frame.schema[name].dataType


def encode(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
    split: int = SPLIT,
) -> DataFrame:
    """Rows ``(id, ids)``: the ids of each text as little-endian unsigned 32-bit integers.

    Equal to the tokenizers library without added special tokens. A null text counts
    as empty and gives no ids. Ids may be null or repeat: each row is encoded by
    itself. Texts of more than ``split`` characters are cut into pieces, which tasks
    encode in parallel; the pieces of a text then meet and are joined as a tree of
    neighbours (see ``bpe.ByteBpe.join``). Such a text's ids are together as large
    as the text, which is one row too. Other columns are ignored.
    """
    schema = StructType([StructField("id", _kind(docs, id_column)), StructField("ids", BinaryType())])
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text")
    )
    special = list(encoder(path).special)
    cut = F.length("text") > split
    for mark in special:  # a text with special tokens is encoded as one
        cut = cut & ~F.contains("text", F.lit(mark))

    def whole():
        bpe = encoder(path)

        def work(batch):
            texts = column(batch, "text")
            yield {"id": batch.column(0), "ids": [bpe.encode(t) for t in texts]}

        return work

    short = map_rows(rows.where(~cut), whole, schema, 500)
    pieces = _pieces(rows.where(cut).withColumn("row", F.monotonically_increasing_id()), split)
    # A stated number, as Spark would put pieces together by their bytes, which are few
    # for the time they take.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = _parts(pieces.repartition(tasks, "row", "piece"), path)
    long = parts.groupBy("row").applyInPandas(_joiner(path), _long_schema(docs, id_column))
    return short.unionByName(long)


def _long_schema(docs: DataFrame, id_column: str) -> StructType:
    return StructType([StructField("id", _kind(docs, id_column)), StructField("ids", BinaryType())])


def _pieces(rows: DataFrame, split: int) -> DataFrame:
    schema = StructType([
        StructField("row", LongType()), StructField("id", rows.schema["id"].dataType),
        StructField("piece", IntegerType()), StructField("text", StringType()),
    ])

    def make():
        def work(batch):
            for row, i, text in zip(column(batch, "row"), column(batch, "id"), column(batch, "text")):
                starts = range(0, len(text), split)
                yield {
                    "row": [row] * len(starts), "id": [i] * len(starts),
                    "piece": range(len(starts)), "text": [text[s : s + split] for s in starts],
                }

        return work

    return map_rows(rows, make, schema, 50)


def _parts(pieces: DataFrame, path: str) -> DataFrame:
    schema = StructType([
        *pieces.schema.fields,
        *(StructField(n, BinaryType()) for n in ("ends", "counts", "ids")),
    ])

    names = pieces.schema.names

    def make():
        bpe = encoder(path)

        def work(batch):
            found = [bpe.part(t) for t in column(batch, "text")]
            yield {n: batch.column(i) for i, n in enumerate(names)} | {
                "ends": [p.ends.tobytes() for p in found],
                "counts": [p.counts.tobytes() for p in found],
                "ids": [p.ids.tobytes() for p in found],
            }

        return work

    return map_rows(pieces, make, schema, 50)


def _joiner(path: str):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        parts = [
            Part(t, np.frombuffer(e, np.int64), np.frombuffer(c, np.int64), np.frombuffer(i, np.uint32))
            for t, e, c, i in zip(rows["text"], rows["ends"], rows["counts"], rows["ids"])
        ]
        ids = encoder(path).tree(parts).ids.astype("<u4").tobytes()
        return pd.DataFrame({"id": rows["id"].iloc[:1].to_list(), "ids": [ids]})

    return join


def decode(encoded: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """The same rows with ``decoded``, the text of their ids, special tokens included.

    Null ids give a null text; bytes that are no UTF-8 become U+FFFD.
    """
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    names = encoded.schema.names

    def make():
        bpe = encoder(path)

        def work(batch):
            texts = [None if x is None else bpe.decode(x).decode() for x in column(batch, ids_column)]
            yield {n: batch.column(i) for i, n in enumerate(names)} | {"decoded": texts}

        return work

    return map_rows(encoded, make, schema, 500)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of encoded rows, decoded for it."""
    schema = StructType([
        StructField("id", encoded.schema["id"].dataType), StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()),
    ])

    def make():
        bpe = encoder(path)

        def work(batch):
            ids = column(batch, "ids")
            yield {
                "id": batch.column(0),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }

        return work

    return map_rows(encoded, make, schema, 500)
