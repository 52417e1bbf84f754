"""Operator 7: best-fit packing of token sequences after dominance reduction."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from msgrisk.llm.bpe import WordBpe
from msgrisk.llm.common import column, in_ranges, map_rows, stored

CAPACITY = 2048  # tokens of a sequence
END_ID = 0  # follows each document
OWN = ("id", "row", "piece", "start", "length", "ids_crc32")  # columns of pieces

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), in order of place


@cache
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def pieces(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """``(id, row, piece, start, length, ids_crc32[, ids])``: documents as pieces.

    A document is its ids followed by id 0, so a null or empty text is one piece of
    length 1. Only documents above the capacity are cut, into full pieces and a rest.
    """
    schema = StructType([
        StructField("id", docs.schema[id_column].dataType), StructField("row", LongType()),
        StructField("piece", IntegerType()), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids_crc32", LongType()),
        *([StructField("ids", BinaryType())] if with_ids else []),
    ])
    end = np.array([END_ID], "<u4").tobytes()

    def make():
        bpe = encoder(path)

        def work(batch):
            ids, rows = column(batch, "id"), column(batch, "row")
            out = {n: [] for n in schema.names}
            for i, row, tokens in zip(ids, rows, bpe.encode_batch(column(batch, "text"))):
                tokens += end
                for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[at : at + 4 * capacity]
                    values = (i, row, piece, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for n, v in zip(schema.names, values):
                        out[n].append(v)
            yield out

        return work

    rows = docs.select(
        F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"),
        F.coalesce(text_column, F.lit("")).alias("text"),
    )
    return map_rows(rows, make, schema, 1000)


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Fix sequences that some best packing has; ``counts`` keeps what is left.

    A set of pieces beside the largest piece s dominates another if the other's
    pieces fit into its own, one group in each. So s goes with a single piece k when
    nothing else that fits beside s holds more than k: k fills the rest exactly, or no
    two pieces fit, or no three do and no two hold more than k. A piece that leaves
    room for none goes alone.
    """
    fixed: list[tuple[int, Pattern]] = []
    lengths = sorted(length for length, n in counts.items() if n)
    for s in list(reversed(lengths)):
        while counts.get(s, 0):
            rest = capacity - s
            counts[s] -= 1
            small = [x for x in lengths[: bisect_left(lengths, rest + 1)] if counts[x]]
            counts[s] += 1
            if not small:
                fixed.append((counts[s], ((s, 1),)))
                counts[s] = 0
                break
            k = small[-1]
            if k != rest and not _single_dominates(small, counts, s, k, rest):
                break
            if k == s:
                times = counts[s] // 2
                fixed.append((times, ((s, 2),)))
                counts[s] -= 2 * times
            else:
                times = min(counts[s], counts[k])
                fixed.append((times, ((s, 1), (k, 1))))
                counts[s] -= times
                counts[k] -= times
    return fixed


def _single_dominates(small: list[int], counts: dict[int, int], s: int, k: int, rest: int) -> bool:
    smallest: list[int] = []
    for x in small:
        smallest += [x] * min(counts[x] - (x == s), 3 - len(smallest))
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > rest:
        return True
    if len(smallest) == 3 and sum(smallest) <= rest:
        return False
    i, j, best = 0, len(small) - 1, 0
    while i <= j:
        both = small[i] + small[j]
        if both <= rest:
            if i < j or counts[small[i]] - (small[i] == s) > 1:
                best = max(best, both)
            i += 1
        else:
            j -= 1
    return best <= k


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing, for all pieces of a length and all alike sequences at once."""
    open_: dict[int, list[tuple[int, Pattern]]] = {}
    spaces: list[int] = []

    def put(times: int, pattern: Pattern, space: int) -> None:
        if times:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append((times, pattern))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                space, times, pattern = capacity, -(-n // (capacity // length)), ()
            else:
                space = spaces[at]
                times, pattern = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
            each = space // length
            full, rest = min(times, n // each), 0
            put(full, (*pattern, (length, each)), space - each * length)
            n -= full * each
            if full < times and n:
                rest, n = n, 0
                put(1, (*pattern, (length, rest)), space - rest * length)
            if pattern:
                put(times - full - bool(rest), pattern, space)
    return [group for space in spaces for group in open_[space]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """How often which pattern of lengths is packed: ``[(times, pattern)]``."""
    left = {length: n for length, n in counts.items() if n}
    fixed = reduce_dominated(left, capacity)
    return fixed + best_fit({k: n for k, n in left.items() if n}, capacity)


class Places:
    """Looks up the place of the r-th piece of a length."""

    def __init__(self, patterns: list[tuple[int, Pattern]]):
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        base = 0
        for times, pattern in patterns:
            offset = 0
            for length, each in pattern:
                rank = taken.get(length, 0)
                found.setdefault(length, []).append((rank, times, base, offset))
                taken[length] = rank + times * each
                offset += length * each
            base += times
        self.tables = {k: np.array(v, np.int64).T for k, v in found.items()}
        self.sequences = base

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by length and rank (from 0) within it."""
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            mine = lengths == length
            first, times, base, start = self.tables[int(length)]
            at = np.searchsorted(first, ranks[mine], "right") - 1
            inside = ranks[mine] - first[at]
            sequence[mine] = base[at] + inside % times[at]
            offset[mine] = start[at] + inside // times[at] * length
        return sequence, offset


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Add ``rank``, the position from 0 of a row among those of its length.

    Rows are dealt out by range, so those of a frequent length lie in many tasks;
    each counts its own, and only counts per task and length are summed up.
    """
    numbered = in_ranges(rows, ["length", *by], "numbered")
    # A range holds few lengths in order: the first place and the number of each.
    counts = numbered.groupBy("length", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    joined = numbered.join(counts.select("length", "part", shift.alias("shift")), ["length", "part"])
    return joined.withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``.

    Takes the rows of ``pieces``; any other columns are carried along, whatever their
    names but for the two new ones. What the plan
    needs to know is how many pieces each length has: at most ``capacity`` numbers,
    whatever the table. The plan is a list of patterns and how often each is used; a
    piece finds its place by its rank among the pieces of its length. Sequences have
    no gaps, numbers start at 0. An empty table gives an empty result.
    """
    own = [c for c in rows.columns if c in OWN]
    more = [c for c in rows.columns if c not in OWN]
    # Other columns go in one, out of the way of the names that are used here.
    one = rows.select(*own, F.struct(*[F.col(f"`{c}`") for c in more]).alias("carried")) if more else rows
    made = _packed(one, capacity)
    carried = [F.col("carried")[c].alias(c) for c in more]
    return made.select(*own, *carried, "sequence_id", "offset")


def _packed(rows: DataFrame, capacity: int) -> DataFrame:
    rows = stored(rows, "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    places = Places(plan(counts, capacity))
    sorted_rows = ranked(rows, ["id", "row", "piece"])
    names = [n for n in sorted_rows.schema.names if n != "rank"]
    schema = StructType([
        *(sorted_rows.schema[n] for n in names),
        StructField("sequence_id", LongType()), StructField("offset", LongType()),
    ])
    shared = rows.sparkSession.sparkContext.broadcast(places)

    def make():
        def work(batch):
            lengths = np.array(column(batch, "length"), np.int64)
            sequence, offset = shared.value.of(lengths, np.array(column(batch, "rank"), np.int64))
            columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
            yield columns | {"sequence_id": sequence, "offset": offset}

        return work

    return map_rows(sorted_rows, make, schema, 100_000)
