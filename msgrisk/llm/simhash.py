"""Operator 4: near-duplicates by SimHash and covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from msgrisk.llm.common import Rounds, column, map_rows, of_key, row_key, stored

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 2048  # fingerprints compared within one bucket; larger buckets are split


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text's words; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shifted = [words[i:] for i in range(min(words_per_shingle, len(words)))]
    shingles = map(b" ".join, zip(*shifted))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65_536):
        block = hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, digest, fp)``; ``fp`` holds the 64 bits as a signed long."""
    schema = StructType([
        StructField("id", docs.schema[id_column].dataType),
        StructField("digest", StringType()), StructField("fp", LongType()),
    ])

    def make():
        def work(batch):
            found = np.array([fingerprint(t) for t in column(batch, "text")], np.uint64)
            yield {"id": batch.column(0), "digest": batch.column(1), "fp": found.view(np.int64)}

        return work

    rows = docs.select(
        F.col(id_column).alias("id"), _digest(F.col(text_column)).alias("digest"),
        F.col(text_column).alias("text"),
    )
    return map_rows(rows, make, schema)


def covering_masks(radius: int = RADIUS, turn: int = 0) -> list[int]:
    """Bit masks of which one misses any ``radius`` bits.

    Each bit has a non-zero vector of radius + 1 bits. The mask of a non-zero vector
    v holds the bits whose vectors have an odd product with v. Any ``radius``
    vectors leave some v orthogonal to all of them, and its mask has none of their
    bits. ``turn`` deals out the vectors differently.
    """
    size = 2 ** (radius + 1) - 1
    order = np.random.default_rng(SEED + turn).permutation(BITS)
    vector = [int(order[bit]) % size + 1 for bit in range(BITS)]
    return [
        sum(1 << bit for bit in range(BITS) if (vector[bit] & v).bit_count() % 2)
        for v in range(1, size + 1)
    ]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keys(masks: list[int]) -> Column:
    """One key per mask: the number of the mask and the bits under it."""
    return F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits"))
            for i, m in enumerate(masks)
        ])
    )


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a > b, that connect all fingerprints within the radius.

    In each bucket the fingerprints that are connected there get a star of links to
    the smallest, so a bucket gives fewer links than it has members and no
    connection is lost. A bucket above ``BUCKET`` members is split by a further set
    of covering masks on its free bits, with the same guarantee, and so on; each
    split fixes half of the free bits, so this ends.
    """
    parts, turn = [], 0
    rows = prints.select("fp", _keys(covering_masks()).alias("key"))
    rows = rows.select("fp", "key.bits", F.array("key.table").alias("tables"))
    fixed = {(i,): m for i, m in enumerate(covering_masks())}
    while True:
        rows = stored(rows, "buckets")
        sizes = rows.groupBy("tables", "bits").count().where(F.col("count") > BUCKET)
        large = stored(sizes.select("tables", "bits"), "large-buckets")
        some = not large.isEmpty()
        small = rows.join(large, ["tables", "bits"], "left_anti") if some else rows
        parts.append(_linked(small))
        if not some:
            break
        turn += 1
        masks = covering_masks(turn=turn)
        used = [tuple(r[0]) for r in large.select("tables").distinct().collect()]
        fixed = {(*t, i): fixed[t] | m for t in used for i, m in enumerate(masks)}
        rows = _split(rows.join(large, ["tables", "bits"]), fixed)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct()


def _split(rows: DataFrame, fixed: dict[tuple[int, ...], int]) -> DataFrame:
    """The rows of large buckets with one more table each."""
    masks = rows.sparkSession.createDataFrame(
        [(list(t[:-1]), list(t), signed(m)) for t, m in fixed.items()],
        "tables array<int>, longer array<int>, mask bigint",
    )
    return rows.join(F.broadcast(masks), "tables").select(
        "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), F.col("longer").alias("tables")
    )


def _linked(rows: DataFrame) -> DataFrame:
    """Links within buckets; sorted buckets pass through a task one after the other."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, prints in _groups(batches):
            a, b = star_links(np.unique(prints))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keyed = rows.select(F.xxhash64("tables", "bits").alias("bucket"), "fp")
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted rows as groups of two members or more."""
    last, held = None, []
    for batch in batches:
        keys, values = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(keys):
            continue
        edges = np.flatnonzero(np.diff(keys)) + 1
        bounds = [0, *edges.tolist(), len(keys)]
        if keys[0] != last:
            if held and sum(map(len, held)) > 1:
                yield last, np.concatenate(held)
            held = []
        else:
            held.append(values[: bounds[1]])
            if len(bounds) == 2:
                continue
            yield last, np.concatenate(held)
            held, bounds = [], bounds[1:]
        sizes = np.diff(bounds)
        for i in np.flatnonzero(sizes[:-1] > 1):
            yield keys[bounds[i]], values[bounds[i] : bounds[i + 1]]
        last, held = keys[-1], [values[bounds[-2] :]]
    if held and sum(map(len, held)) > 1:
        yield last, np.concatenate(held)


def star_links(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Connected members of a bucket, each with the smallest one it is connected to."""
    a, b = [], []
    left = prints  # sorted
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= radius
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                a.append(found)
                b.append(np.full(len(found), root))
    if not a:
        return np.array([], np.int64), np.array([], np.int64)
    return np.concatenate(a), np.concatenate(b)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the links; the root is its component's smallest.

    Alternates two steps that keep what is connected connected: each node hands its
    larger neighbours, then its smaller ones, to the smallest node it knows. It ends
    when every link leads from a node to its root. Each round is written to the
    shared folder.
    """
    rounds = Rounds("links")
    edges = rounds.stored(edges)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = both.groupBy("a").agg(F.min("b").alias("m"))
        known = known.select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(known, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = rounds.stored(larger.where("a != b").distinct())
        known = edges.groupBy("a").agg(F.min("b").alias("m"))
        smaller = edges.join(known, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = rounds.stored(smaller.union(known.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.count_distinct("a"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``id, digest, fp, component_id``.

    ``component_id`` is the smallest id reachable over links of fingerprints that
    differ in 3 bits or fewer. Null and empty texts, and texts of white space only,
    have fingerprint zero. Equal fingerprints are one class from the start, so copies
    cost one comparison. Null ids take part but are no component's id, unless all
    ids of a component are null. ``digest`` is that of the text; other columns are
    ignored. An empty table gives an empty result.
    """
    return _rooted(docs, id_column, text_column).drop("root")


def _rooted(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``near_groups`` with the smallest fingerprint of the component, ``root``."""
    prints = stored(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = stored(components(links(classes)), "roots")
    tied = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tied.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("id", "digest", "fp", "component_id", "root")


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, with all its columns.

    Null ids count as larger than all others. Rows are known by their id and a digest
    of their text; of rows that share both, one stays.
    """
    groups = _rooted(docs, id_column, text_column)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("first")
    kept = groups.groupBy("root").agg(first)
    kept = kept.select(row_key(F.col("first.id"), F.col("first.digest")))
    return of_key(docs, row_key(F.col(id_column), _digest(F.col(text_column))), kept)


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))
