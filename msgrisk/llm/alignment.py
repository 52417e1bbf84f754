"""Operator 13: alignment of two tokenizations of the same texts, on Arrow arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from msgrisk.llm.bpe import ByteBpe
from msgrisk.llm.common import column, grown, map_rows, shrunk, stored

BLOCK = 2_000_000  # links after which the pairs of a block of documents are counted
PART = 1 << 20  # bytes of text that are tokenized at once, beyond a text's own

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class ByteSide:
    """Ids and bytes of tokens by a byte-level vocabulary; all of a text is plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = ByteBpe(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.no_truncation()
        self.plain.no_padding()
        raw = self.bpe.bytes_of
        self.raw = pa.array([raw.get(i, b"") for i in range(max(raw) + 1)], pa.large_binary())

    def ids(self, text: str) -> np.ndarray:
        if self.bpe.marks.search(text):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.bpe.encode(text), "<u4")


class PieceSide:
    """Ids and bytes of tokens by a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.raw = pa.array(
            [self._bytes(i) for i in range(self.model.get_piece_size())], pa.large_binary()
        )

    def _bytes(self, number: int) -> bytes:
        piece = self.model.id_to_piece(number)
        if self.model.is_byte(number):  # <0xHH>
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.uint32)


@cache
def side(kind: type, path: str):
    return kind(path)


def lists_of(rows: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64))
    flat = np.concatenate([np.zeros(0, np.uint32), *rows])
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.uint32()))


def joined_bytes(tokens: pa.LargeListArray, raw: pa.Array) -> pa.Array:
    """The bytes of each list of tokens."""
    offsets = tokens.offsets.cast(pa.int32())
    pieces = pa.ListArray.from_arrays(offsets, raw.take(tokens.flatten()).cast(pa.binary()))
    return pc.binary_join(pieces, b"")


def token_ends(tokens: pa.LargeListArray, raw: pa.Array, name: str) -> pa.Table:
    """One row per token: its document-end key and its place among all tokens.

    The end is a cumulative sum of token lengths, segmented by the parent index. A key
    holds the document in the upper 32 bits and the end in the lower ones.
    """
    ids, parent = tokens.flatten(), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pc.binary_length(raw.take(ids)).cast(pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(tokens.offsets[:-1])
    end = pc.subtract(total, before.take(parent))
    key = pc.add(pc.shift_left(parent.cast(pa.int64()), 32), end)
    place = pa.array(np.arange(len(ids), dtype=np.int64))
    return pa.table({"doc_end": key, name: place})


def covers(a: pa.LargeListArray, raw_a: pa.Array, b: pa.LargeListArray, raw_b: pa.Array) -> pa.Table:
    """One row per overlapping pair of tokens: ``doc, a, b`` (places) and ``shared``.

    The ends of both sides cut a text into stretches, each in one token of either side,
    and two tokens overlap in one stretch at most. So the outer hash join of the ends
    has a row for each overlapping pair; the token that covers a stretch is the next
    one that ends. ``shared`` marks ends of both, where a group closes.
    """
    left, right = token_ends(a, raw_a, "a"), token_ends(b, raw_b, "b")
    ends = left.join(right, "doc_end", join_type="full outer", use_threads=False)
    ends = ends.sort_by("doc_end").combine_chunks()
    place_a, place_b = (ends[n].combine_chunks() for n in ("a", "b"))
    return pa.table({
        "doc": pc.shift_right(ends["doc_end"], 32),
        "a": pc.fill_null_backward(place_a),
        "b": pc.fill_null_backward(place_b),
        "shared": pc.and_(place_a.is_valid(), place_b.is_valid()),
    })


def group_texts(a: pa.LargeListArray, b: pa.LargeListArray, cover: pa.Table, docs: int) -> list[str]:
    """The groups of each document as ``a1,a2|b1;a3|b2,b3``."""
    closing = cover.filter(cover["shared"])

    def of_side(tokens: pa.LargeListArray, name: str) -> pa.Array:
        ends = np.append(0, closing[name].to_numpy() + 1).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(ends, tokens.flatten().cast(pa.string())), ",")

    groups = pc.binary_join_element_wise(of_side(a, "a"), of_side(b, "b"), "|")
    per_doc = np.bincount(closing["doc"].to_numpy(), minlength=docs)
    ends = np.append(0, np.cumsum(per_doc)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(ends, groups), ";").to_pylist()


def aligned(texts: list[str | None], left: ByteSide, right: PieceSide) -> tuple[dict[str, list], pa.Table]:
    """Counts and group digest of each text, and its linked id pairs.

    The pairs are a table ``doc, pair, times``: for each text its distinct pairs of
    ids, as ``a << 32 | b``, and how many of its links have them, texts in order.
    """
    whole = [" " + t if t else "" for t in texts]
    a = lists_of([left.ids(t) if t else np.zeros(0, np.uint32) for t in whole])
    b = lists_of([right.ids(t[1:]) if t else np.zeros(0, np.uint32) for t in whole])
    want = pa.array([t.encode() for t in whole], pa.binary())
    same = pc.and_(pc.equal(joined_bytes(a, left.raw), want), pc.equal(joined_bytes(b, right.raw), want))
    if not pc.all(same).as_py():  # texts that a side does not give back have no tokens
        keep = same.to_pylist()
        a, b = (lists_of([x.values.to_numpy() if k else x.values.to_numpy()[:0] for x, k in zip(side, keep)])
                for side in (a, b))
    cover = covers(a, left.raw, b, right.raw)
    closed = group_texts(a, b, cover, len(texts))
    doc = cover["doc"].to_numpy()
    groups = np.bincount(doc[cover["shared"].to_numpy()], minlength=len(texts))
    out = {
        "n_a": pc.list_value_length(a).to_pylist(), "n_b": pc.list_value_length(b).to_pylist(),
        "n_groups": groups, "n_links": np.bincount(doc, minlength=len(texts)),
        "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in closed],
        "groups": closed,
    }
    ids = [side.flatten().cast(pa.int64()).take(cover[n]) for side, n in ((a, "a"), (b, "b"))]
    links = pa.table({"doc": cover["doc"], "pair": pc.add(pc.shift_left(ids[0], 32), ids[1])})
    pairs = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    return out, pairs.rename_columns(["doc", "pair", "times"])


def by_bytes(texts: list[str | None]) -> Iterator[slice]:
    """Stretches of texts of about ``PART`` bytes; a longer text is one of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + 64
        if size >= PART:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def doc_links(pairs: pa.Table, place: np.ndarray, docs: int) -> dict[str, list]:
    """Each document's pairs as compressed places in its block, ascending, and their times."""
    doc, times = pairs["doc"].to_numpy(), pairs["times"].to_numpy()
    order = np.lexsort((place, doc))
    place, times = place[order], times[order]
    ends = np.cumsum(np.bincount(doc, minlength=docs))
    starts = np.append(0, ends[:-1])
    step = np.diff(place, prepend=0)
    firsts = starts[starts < ends]
    step[firsts] = place[firsts]
    spans = list(zip(starts, ends))
    return {
        "n_pairs": ends - starts,
        "places": [shrunk(step[s:e]) for s, e in spans],
        "times": [shrunk(times[s:e]) for s, e in spans],
    }


def token_blocks(
    docs: DataFrame, path_a: str, path_b: str, id_column: str, text_column: str, with_groups: bool
) -> DataFrame:
    """Documents with their counts and linked pairs, in blocks, and a head per block.

    A block is what one task aligned in a row: up to about ``BLOCK`` links, more only
    where one document has more. Its head lists the distinct pairs of ids, most
    frequent first, and how many documents of the block hold each: the partial
    counts. A document refers to the pairs by their places in that list. The rows are
    to be written before use, as block numbers hold for one run of a task.
    """
    kept = [StructField("groups", StringType())] if with_groups else []
    schema = StructType([
        StructField("block", LongType()), StructField("id", docs.schema[id_column].dataType),
        *(StructField(n, LongType()) for n in COUNTS), StructField("groups_sha256", StringType()), *kept,
        StructField("n_pairs", LongType()), StructField("places", BinaryType()),
        StructField("times", BinaryType()),
        StructField("head_pairs", BinaryType()), StructField("head_docs", BinaryType()),
    ])

    def make():
        from pyspark import TaskContext

        left, right = side(ByteSide, path_a), side(PieceSide, path_b)
        number = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))

        def closed(parts: list[tuple[list, dict, pa.Table]]):
            block, offset, shifted = next(number), 0, []
            rows: dict[str, list] = {n: [] for n in schema.names}
            for ids, found, pairs in parts:
                shifted.append(pairs.set_column(0, "doc", pc.add(pairs["doc"], offset)))
                offset += len(ids)
                rows["id"] += ids
                for n in found:
                    rows[n] += list(found[n])
            pairs = pa.concat_tables(shifted).combine_chunks()
            counts = pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")])
            counts = counts.sort_by([("count_all", "descending"), ("pair", "ascending")])
            place = pc.index_in(pairs["pair"], counts["pair"]).to_numpy().astype(np.int64)
            rows |= {k: list(v) for k, v in doc_links(pairs, place, offset).items()}
            rows["block"] = [block] * offset
            rows["head_pairs"] = rows["head_docs"] = [None] * offset
            yield rows
            yield {n: [None] for n in schema.names} | {
                "block": [block], "n_pairs": [len(counts)],
                "head_pairs": [pa.compress(counts["pair"].to_numpy().tobytes(), "zstd", asbytes=True)],
                "head_docs": [shrunk(counts["count_all"].to_numpy())],
            }

        def work(batch):
            ids, texts = column(batch, "id"), column(batch, "text")
            parts, links = [], 0
            for some in by_bytes(texts):
                found, pairs = aligned(texts[some], left, right)
                if not with_groups:
                    found.pop("groups")
                parts.append((ids[some], found, pairs))
                links += int(found["n_links"].sum())
                if links >= BLOCK:
                    yield from closed(parts)
                    parts, links = [], 0
            if parts:
                yield from closed(parts)

        return work

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return map_rows(rows, make, schema)


def partial_counts(blocks: DataFrame) -> DataFrame:
    """``(block, place, a, b, docs)``: the heads of the blocks, one row per pair of ids."""
    schema = StructType([
        StructField("block", LongType()), StructField("place", IntegerType()),
        StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("docs", LongType()),
    ])

    def make():
        def work(batch):
            names = ("block", "n_pairs", "head_pairs", "head_docs")
            for block, n, pairs, docs in zip(*(column(batch, x) for x in names)):
                pairs = np.frombuffer(pa.decompress(pairs, 8 * n, "zstd", asbytes=True), np.int64)
                for at in range(0, n, 100_000):
                    some = slice(at, min(n, at + 100_000))
                    yield {
                        "block": np.full(some.stop - at, block), "place": np.arange(at, some.stop),
                        "a": pairs[some] >> 32, "b": pairs[some] & 0xFFFFFFFF, "docs": grown(docs, n)[some],
                    }

        return work

    heads = blocks.where(F.col("head_pairs").isNotNull())
    return map_rows(heads.select("block", "n_pairs", "head_pairs", "head_docs"), make, schema, 20)


def pair_counts(partial: DataFrame) -> DataFrame:
    """``(a, b, docs, best)``: in how many documents a pair is linked, and whether no
    other pair of its A id is in more. An A id has as many rows as B has ids at most."""
    totals = partial.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(Window.partitionBy("a"))
    return totals.withColumn("best", F.col("docs") == most)


def align(
    docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text",
    with_groups: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Two tokenizations of each text side by side: documents, and pairs of ids.

    Documents are ``id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` (and ``groups``), pairs as in ``pair_counts``. A encodes a space and
    the text, B the text; strings of special tokens are plain text. A group closes
    where tokens of both end; a link is a pair of tokens whose bytes overlap. Null and
    empty texts, and those that the tokens of a side do not give back byte for byte,
    have no tokens. Each row counts by itself, so repeated rows count twice; ids may
    be null; other columns are ignored. An empty table gives empty results.

    A text stays in its task. Between tasks move the distinct pairs of a block of
    documents, to be counted, and the counts back to the block, where they meet the
    places of its documents' links.
    """
    schema_names = ["n_best", "count_sum"]
    blocks = stored(token_blocks(docs, path_a, path_b, id_column, text_column, with_groups), "aligned")
    partial = partial_counts(blocks)
    pairs = stored(pair_counts(partial), "pairs")
    answers = partial.drop("docs").join(pairs, ["a", "b"]).select("block", "place", "docs", "best")
    carried = ["id", *COUNTS, "groups_sha256", *(["groups"] if with_groups else [])]
    schema = StructType([
        *(blocks.schema[n] for n in carried), *(StructField(n, LongType()) for n in schema_names)
    ])

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["place"].to_numpy()
        docs = np.zeros(len(place), np.int64)
        best = np.zeros(len(place), bool)
        docs[place], best[place] = right["docs"].to_numpy(), right["best"].to_numpy()
        totals: dict[str, list[int]] = {n: [] for n in schema_names}
        for n, places, times in zip(*(left[c].to_pylist() for c in ("n_pairs", "places", "times"))):
            mine, often = np.cumsum(grown(places, n)), grown(times, n)
            totals["n_best"].append(int(often[best[mine]].sum()))
            totals["count_sum"].append(int(often @ docs[mine]))
        out = left.select(carried)
        for n in schema_names:
            out = out.append_column(n, pa.array(totals[n], pa.int64()))
        return out

    own = blocks.where(F.col("head_pairs").isNull()).drop("head_pairs", "head_docs")
    found = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(counted, schema)
    return found, pairs
