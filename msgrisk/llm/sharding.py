"""Operator 11: shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from msgrisk.llm.common import column, in_ranges, map_rows

SHARDS = 8
NODES = 64  # virtual nodes of a shard


@dataclass(frozen=True)
class Ring:
    """Points of the virtual nodes in order, and the shard that each arc leads to.

    A key belongs to the first point at or after its position. The stretch of keys
    before a point is its arc; the one after the last point leads to the first.
    """

    points: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, shards: int, nodes: int = NODES) -> Ring:
        if shards < 1 or nodes < 1:
            raise ValueError("a ring needs a shard and a node at least")
        names = [(f"{s}/{v}", s) for s in range(shards) for v in range(nodes)]
        made = sorted((_position(name), s) for name, s in names)
        owners = [s for _, s in made] + [made[0][1]]
        return cls(np.array([p for p, _ in made], np.int64), np.array(owners, np.int64))

    def arcs(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, positions, "left")


def _position(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big", signed=True)


def capacities(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """Rows a shard may hold; without slack, shares that differ by one row at most."""
    share = np.full(shards, rows // shards, np.int64)
    share[: rows % shards] += 1
    return share if slack <= 0 else np.maximum(share, int(np.ceil((1 + slack) * rows / shards)))


@dataclass(frozen=True)
class Plan:
    """Where the keys of each arc go, by their rank in it.

    ``starts`` are first ranks, counted through all arcs in order; from each on, keys
    go to ``shards`` at the slots from ``slots`` on. ``bases`` are the ranks at which
    the arcs begin.
    """

    bases: np.ndarray
    starts: np.ndarray
    shards: np.ndarray
    slots: np.ndarray

    def places(self, arcs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        through = self.bases[arcs] + ranks
        at = np.searchsorted(self.starts, through, "right") - 1
        return self.shards[at], self.slots[at] + through - self.starts[at]


def plan(ring: Ring, counts: np.ndarray, limits: np.ndarray) -> Plan:
    """Bounded loads on the ring, from the number of keys of each arc.

    A shard takes the keys of its own arcs, in ring order, as far as its limit goes.
    What overflows continues clockwise and enters the next arc whose shard has room;
    of keys under way those that left home first enter first. So only keys that a
    full shard could not take move, and everything finds a place within two turns,
    as the limits hold all keys together.
    """
    if counts.sum() > limits.sum():
        raise ValueError("the limits are below the number of keys")
    room, pieces, over = limits.copy(), [], {}
    for arc, shard in enumerate(ring.owners):
        taken = min(int(counts[arc]), int(room[shard]))
        if taken:
            pieces.append((arc, 0, taken, int(shard)))
            room[shard] -= taken
        if taken < counts[arc]:
            over[arc] = (taken, int(counts[arc]) - taken)
    under_way: list[tuple[int, int, int]] = []
    for turn in range(2 * len(ring.owners)):
        arc = turn % len(ring.owners)
        shard = int(ring.owners[arc])
        while under_way and room[shard]:
            home, rank, n = under_way[0]
            taken = min(n, int(room[shard]))
            pieces.append((home, rank, taken, shard))
            room[shard] -= taken
            under_way[0] = (home, rank + taken, n - taken)
            if taken == n:
                under_way.pop(0)
        if arc in over:
            rank, n = over.pop(arc)
            under_way.append((arc, rank, n))
    bases = np.append(0, np.cumsum(counts))
    used, found = np.zeros(len(limits), np.int64), []
    for home, rank, n, shard in sorted(pieces):
        found.append((bases[home] + rank, shard, used[shard]))
        used[shard] += n
    columns = np.array(found, np.int64).reshape(-1, 3).T
    return Plan(bases, *columns)


def assigned(
    docs: DataFrame, id_column: str = "doc_id", shards: int = SHARDS, nodes: int = NODES,
    slack: float = 0.0, shard: str = "shard", slot: str = "slot",
) -> DataFrame:
    """All rows and columns with the shard and the slot, a number from 0 without gaps.

    A row's key is its id: the position on the ring is a hash of it. Keys of an arc
    are ordered by position, id and a row number. Without ``slack`` the shards differ
    by one row at most; with it a shard holds up to ``1 + slack`` times its share,
    and fewer keys leave their home. Null ids are one key, repeated ids too: being more
    than a shard takes does not matter, the rest goes on clockwise. Columns may have any
    names but those of the two new ones. An empty table gives an empty result.

    The rows are sorted along the ring over ranges, so a key with any share of the rows
    lies in many tasks. The plan needs the number of rows of each arc, ``shards`` times
    ``nodes`` numbers whatever the table.
    """
    ring = Ring.of(shards, nodes)
    context = docs.sparkSession.sparkContext
    points = context.broadcast(ring)
    key = F.col(id_column)
    rows = docs.select(
        F.xxhash64(F.lit("key"), key.isNull(), key.cast("string")).alias("position"),
        key.alias("id"), F.monotonically_increasing_id().alias("row"), F.struct("*").alias("columns"),
    )
    ordered = in_ranges(rows, ["position", "id", "row"], "ring")
    with_arc = StructType([StructField("arc", IntegerType()), *ordered.schema.fields])

    def find_arcs():
        def work(batch):
            positions = batch.column(batch.schema.get_field_index("position")).to_numpy()
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            yield columns | {"arc": points.value.arcs(positions).astype(np.int32)}

        return work

    light = map_rows(ordered.select("position", "part", "at"), find_arcs, StructType([
        with_arc["arc"], ordered.schema["position"], ordered.schema["part"], ordered.schema["at"],
    ]), 10_000)
    # Ranges and arcs follow the same order: no more stretches than tasks and arcs together.
    stretches = light.groupBy("arc", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    counts = np.zeros(len(ring.owners), np.int64)
    for row in stretches.groupBy("arc").agg(F.sum("n").alias("n")).collect():
        counts[row["arc"]] = row["n"]
    places = context.broadcast(plan(ring, counts, capacities(int(counts.sum()), shards, slack)))
    earlier = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    shifts = stretches.select("arc", "part", shift.alias("shift"))
    numbered = map_rows(ordered, find_arcs, with_arc, 10_000).join(F.broadcast(shifts), ["arc", "part"])
    schema = StructType([
        ordered.schema["columns"], StructField(shard, IntegerType()), StructField(slot, LongType()),
    ])

    def place():
        def work(batch):
            arcs, ranks = (np.array(column(batch, n), np.int64) for n in ("arc", "rank"))
            found, slots = places.value.places(arcs, ranks)
            columns = batch.column(batch.schema.get_field_index("columns"))
            yield {"columns": columns, shard: found.astype(np.int32), slot: slots}

        return work

    wanted = numbered.select("columns", "arc", (F.col("at") + F.col("shift")).alias("rank"))
    return map_rows(wanted, place, schema, 10_000).select("columns.*", shard, slot)


def sharded(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS,
    nodes: int = NODES,
) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` for each document.

    ``size`` is the number of UTF-8 bytes of the text, none for a null, plus 1. The law
    is ``rows``: shards differ by one row at most. What a key's shard is depends on the
    other keys too, as loads are bounded, so there is no ``grown_shard``. Only ids,
    sizes and checksums move, not texts.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    light = docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assigned(light, "id", shards, nodes).select(
        "id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(placed: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard, rows in the order of their slots, in files over ranges."""
    dealt = placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    dealt.write.partitionBy(shard).parquet(path)
