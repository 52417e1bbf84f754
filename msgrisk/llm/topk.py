"""Operator 5: exact top-k inner products with a KD-tree in each shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from msgrisk.llm.common import stored

K = 5
LEAF = 128  # vectors in a leaf
SHARD = 8192  # vectors in a shard, about
BLOCK = 512  # queries for which bounds are computed at once
SAMPLE = 50_000  # vectors that the shards' borders are learned from, at most
BOXES = 64 << 20  # bytes of the regions' bounding boxes, at most
EXACT = 2.0**53


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of each component; null where a component is null or not finite."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    made = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(~bad, made)


class Tree:
    """Vectors in boxes within boxes: median splits along the widest side."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        low, high, span, children = [], [], [], []

        def build(start: int, stop: int) -> int:
            mine = vectors[order[start:stop]]
            node = len(low)
            low.append(mine.min(axis=0))
            high.append(mine.max(axis=0))
            span.append((start, stop))
            children.append(())
            widths = high[node] - low[node]
            if stop - start > LEAF and widths.any():
                side, middle = int(widths.argmax()), (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(mine[:, side].astype(np.float64), middle)]
                children[node] = (build(start, start + middle), build(start + middle, stop))
            return node

        build(0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array(low), np.array(high)
        self.span, self.children = span, children

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, what no inner product with its vectors exceeds."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def best(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, least: float):
        """The k best ``(score, -id)`` at or above ``least``, best-first over boxes."""
        found: list[tuple[int, int]] = []
        waiting = [(-bounds[0], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            floor = found[0][0] if len(found) == k else least
            if -bound < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(waiting, (-bounds[child], child))
                continue
            start, stop = self.span[node]
            scores = self.vectors[start:stop] @ query
            for at in np.flatnonzero(scores >= floor):
                entry = (int(scores[at]), -int(self.ids[start + at]))
                if -entry[1] == query_id:
                    continue
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        return found


FOUND = StructType([
    StructField(n, LongType()) for n in ("query_id", "vec_id", "score")
])


def _matrix(values: pa.Array, size: int) -> np.ndarray:
    """Lists as rows of a matrix; missing components at the end are 0."""
    lengths = values.value_lengths().to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(values), size), np.int64)
    if (lengths == size).all():
        out[:] = flat.reshape(-1, size)
    else:
        for row, part in zip(out, np.split(flat, np.cumsum(lengths)[:-1])):
            row[: len(part)] = part
    return out


def _search(k: int, size: int):
    """Rows come sorted by shard: first its vectors, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if shards[a] != shard:
                    shard, held, tree = shards[a], [], None
                part = batch.slice(a, b - a)
                asks = part.column(1).to_numpy(zero_copy_only=False)
                vectors = part.filter(pa.array(~asks))
                if vectors.num_rows:
                    held.append((vectors.column(2).to_numpy(), _matrix(vectors.column(3), size)))
                queries = part.filter(pa.array(asks))
                if queries.num_rows and held:
                    if tree is None:
                        ids, rows = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                        tree, held = Tree(ids, _numbers(rows)), [None]
                    for start in range(0, queries.num_rows, BLOCK):
                        yield _answers(tree, queries.slice(start, BLOCK), k, size)

    return run


def _numbers(rows: np.ndarray) -> np.ndarray:
    """Floats, if all sums of products are exact in them; else Python integers."""
    most = float(np.abs(rows).max(initial=0))
    return rows.astype(np.float64) if most**2 * max(1, rows.shape[1]) < EXACT else rows.astype(object)


def _answers(tree: Tree, queries: pa.RecordBatch, k: int, size: int) -> pa.RecordBatch:
    rows = _matrix(queries.column(3), size)
    exact = tree.vectors.dtype != object and _numbers(rows).dtype != object
    limit = float(np.abs(rows).max(initial=0)) * size
    exact = exact and limit * max(1.0, float(np.abs(tree.high).max(initial=0)), float(np.abs(tree.low).max(initial=0))) < EXACT
    if not exact and tree.vectors.dtype != object:
        tree.vectors, tree.low, tree.high = (
            x.astype(np.int64).astype(object) for x in (tree.vectors, tree.low, tree.high)
        )
    rows = rows.astype(np.float64 if exact else object)
    bounds = tree.bounds(rows)
    out: list[tuple[int, int, int]] = []
    asked = zip(queries.column(2).to_pylist(), rows, bounds, queries.column(4).to_pylist())
    for query_id, row, bound, least in asked:
        floor = -np.inf if least is None else least
        out += [(query_id, -i, s) for s, i in tree.best(query_id, row, bound, k, floor)]
    columns = zip(*out) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FOUND.names)


def _borders(vectors: DataFrame, size: int, depth: int) -> list[tuple[int, float]]:
    """Median splits of the space, as a full binary tree: ``(side, value)`` by node."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    rows = _matrix(sample["vector"].combine_chunks(), size).astype(np.float64)
    borders: list[tuple[int, float]] = [(0, np.inf)] * (2**depth - 1)

    def split(node: int, rows: np.ndarray) -> None:
        if node >= len(borders) or not len(rows):
            return
        side = int(np.ptp(rows, axis=0).argmax())
        value = float(np.median(rows[:, side]))
        borders[node] = (side, value)
        split(2 * node + 1, rows[rows[:, side] < value])
        split(2 * node + 2, rows[rows[:, side] >= value])

    split(0, rows)
    return borders


def _regions(vectors: DataFrame, borders: list[tuple[int, float]], size: int) -> DataFrame:
    schema = StructType([StructField("region", LongType()), *vectors.schema.fields])
    at_column = vectors.schema.names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = np.array([s for s, _ in borders], np.int64)
        values = np.array([v for _, v in borders])
        for batch in batches:
            rows = _matrix(batch.column(at_column), size)
            node = np.zeros(len(rows), np.int64)
            while len(borders) and len(node) and node[0] < len(borders):
                above = rows[np.arange(len(rows)), sides[node]] >= values[node]
                node = 2 * node + 1 + above
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), *batch.columns], names=["region", *batch.schema.names]
            )

    return vectors.mapInArrow(run, schema)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best inner products of each query.

    Components become ``floor(256 * x)``; scores are exact. Queries are the rows for
    which ``is_query`` holds; candidates are all rows but those with the query's own
    id. Ties go to the smaller id. Rows without an id, without a vector or with a
    component that is null or not finite take no part. Vectors of unequal length count
    as filled up with zeros. Repeated candidates count each; of a repeated query the
    smallest vector asks.

    Vectors are dealt to regions by a coarse KD split learned on a bounded sample, and
    regions above the size of a shard (copies of one vector, say) to several shards by id.
    Each query first visits one shard in full. The k-th score it has then goes along to
    all other shards whose region's box can hold a better one; trees prune by it. There
    are as many regions as shards, but no more than the sample can part and than have
    boxes of ``BOXES`` bytes together, which all tasks get; regions beyond that have more
    shards each.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), whole_numbers(F.col(vector_column)).alias("vector"),
        is_query.alias("asks"),
    ).where("id is not null and vector is not null")
    rows = stored(rows, "vectors")
    count, size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count or not size:
        size = 1
    depth = max(0, int(np.ceil(np.log2(max(1, count / SHARD)))))
    depth = min(depth, int(np.log2(SAMPLE)), max(0, int(np.log2(BOXES / (16 * size)))))
    borders = _borders(rows, size, depth)
    dealt = _regions(rows, borders, size)
    in_region = {r["region"]: r["count"] for r in dealt.groupBy("region").count().collect()}
    split = rows.sparkSession.createDataFrame(
        [(r, -(-n // (2 * SHARD))) for r, n in in_region.items()], "region bigint, pieces bigint"
    )
    dealt = dealt.join(F.broadcast(split), "region").withColumn(
        "shard", F.xxhash64("region", F.pmod(F.xxhash64("id"), F.col("pieces")))
    ).drop("pieces")
    dealt = stored(dealt, "shards")
    queries = dealt.where("asks").groupBy("id").agg(F.min(F.struct("vector", "shard")).alias("q"))
    queries = stored(queries.select("id", "q.vector", "q.shard"), "queries")

    none = F.lit(None).cast("double")
    own = dealt.select("shard", F.lit(False).alias("asks"), "id", "vector", none.alias("least"))
    home = queries.select("shard", F.lit(True).alias("asks"), "id", "vector", none.alias("least"))
    first = stored(_visit(own.unionByName(home), k, size), "first-visits")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = kth.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))

    found = _promising(queries.join(kth, "id", "left"), _boxes(dealt, size), size)
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece")
    others = found.join(F.broadcast(split), "region").select("*", piece)
    others = others.withColumn("shard", F.xxhash64("region", "piece")).where("shard != home")
    others = others.select("shard", F.lit(True).alias("asks"), "id", "vector", "least")
    rest = _visit(own.unionByName(others), k, size)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visit(rows: DataFrame, k: int, size: int) -> DataFrame:
    dealt = rows.repartition("shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInArrow(_search(k, size), FOUND)


def _boxes(dealt: DataFrame, size: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The bounding box of each region; their number is bounded."""
    sides = [
        f(F.coalesce(F.get("vector", F.lit(i)), F.lit(0))).alias(f"{n}{i}")
        for i in range(size) for n, f in (("l", F.min), ("h", F.max))
    ]
    boxes = dealt.groupBy("region").agg(*sides).collect()
    return [
        (r["region"], *(np.array([float(r[f"{n}{i}"]) for i in range(size)]) for n in "lh")) for r in boxes
    ]


def _promising(queries: DataFrame, boxes: list, size: int) -> DataFrame:
    """Queries with each region that can hold a score worth having."""
    shared = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions = np.array([b[0] for b in shared.value], np.int64)
        low = np.array([b[1] for b in shared.value]).reshape(-1, size)
        high = np.array([b[2] for b in shared.value]).reshape(-1, size)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rows = _matrix(part.column(1), size).astype(np.float64)
                bounds = np.maximum(rows, 0) @ high.T + np.minimum(rows, 0) @ low.T
                bounds += np.abs(bounds) * 1e-9 + 1  # beyond rounding
                least = part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                at, to = np.nonzero(bounds >= np.nan_to_num(least, nan=-np.inf)[:, None])
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(regions[to]), *taken.columns], names=["region", "id", "vector", "home", "least"]
                )

    asked = queries.select("id", "vector", F.col("shard").alias("home"), F.col("least").cast("double").alias("least"))
    return asked.mapInArrow(run, StructType([StructField("region", LongType()), *asked.schema.fields]))
