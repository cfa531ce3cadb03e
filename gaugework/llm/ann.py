"""Operator 2: nearest neighbours by a block matrix join. Vectors are quantised to int8; product tiles give inner products with error bounds; pairs whose upper
bound reaches a query's k-th best lower bound are computed again from the original vectors in double precision and merged by heaps. The result is exact.

Original vectors go to the cells, in the precision that they are stored in: of a group of near copies, which may be a third of all rows, every pair survives the bounds, and
as rows of a shuffle these would grow with its square; within a cell they cost a product each and a heap holds k of them."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import base

#: Queries and candidates of a cell of the grid, and rows and columns of a tile.
QUERY_BLOCK, SHARD, TILE_ROWS, TILE_COLUMNS = 4096, 16384, 256, 4096
#: Dimensions that one product may sum: integers up to 127 * 127 * 1024 are exact in float32.
EXACT_DIMENSIONS = 1024


def usable(v: Column) -> Column:
    """Vectors that are null, zero, or hold null or non-finite components take no part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


class Block:
    """Vectors with what their tiles need: int8 parts, scales, norms and norms of the quantisation error."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.scale = np.maximum(np.abs(vectors).max(axis=1) / 127, np.nextafter(0, 1))  # of the smallest of all numbers a share is none
        self.small = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        near = self.small * self.scale[:, None]
        self.near_norm, self.error, self.norm = _norms(near), _norms(vectors - near), _norms(vectors)


def _norms(rows: np.ndarray) -> np.ndarray:
    """Lengths, whose squares neither vanish nor overflow."""
    most = np.abs(rows).max(axis=1)
    return most * np.linalg.norm(rows / np.where(most > 0, most, 1)[:, None], axis=1)


def tile(q: Block, rows: slice, c: Block, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of a tile, and bounds of their errors (with room for rounding)."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _tile(q, rows, c, columns)


def _tile(q: Block, rows: slice, c: Block, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    total = None
    for at in range(0, q.small.shape[1], EXACT_DIMENSIONS):
        part = q.small[rows, at:at + EXACT_DIMENSIONS].astype(np.float32) @ c.small[columns, at:at + EXACT_DIMENSIONS].astype(np.float32).T
        total = part.astype(np.float64) if total is None else total + part
    estimate = total * (q.scale[rows, None] * c.scale[None, columns])
    bound = q.near_norm[rows, None] * c.error[None, columns] + q.error[rows, None] * c.norm[None, columns]
    return estimate, bound + 1e-9 * (q.norm[rows, None] * c.norm[None, columns])


class Search:
    """The best k candidates of each query of a block, as candidate blocks pass by."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.least = np.full(len(queries.ids), -np.inf)

    def add(self, c: Block) -> None:
        q, k = self.queries, self.k
        for r in range(0, len(q.ids), TILE_ROWS):
            rows = slice(r, r + TILE_ROWS)
            for s in range(0, len(c.ids), TILE_COLUMNS):
                columns = slice(s, s + TILE_COLUMNS)
                estimate, bound = tile(q, rows, c, columns)
                own = q.ids[rows, None] == c.ids[None, columns]
                low = np.where(own | np.isnan(estimate - bound), -np.inf, estimate - bound)
                limit = self.least[rows].copy()
                if low.shape[1] >= k:
                    limit = np.maximum(limit, np.partition(low, -k, axis=1)[:, -k])
                i, j = np.nonzero(~(estimate + bound < limit[:, None]) & ~own)  # where numbers overflow, no bound holds
                for a in range(0, len(i), 1 << 16):
                    self.merge(i[a:a + (1 << 16)] + r, j[a:a + (1 << 16)] + s, c)

    def merge(self, i: np.ndarray, j: np.ndarray, c: Block) -> None:
        with np.errstate(over="ignore"):
            scores = (self.queries.vectors[i] * c.vectors[j]).sum(axis=1)
        for row, score, vec in zip(i.tolist(), scores.tolist(), c.ids[j].tolist(), strict=True):
            heap = self.heaps[row]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -vec))
            else:
                heapq.heappushpop(heap, (score, -vec))
            if len(heap) == self.k:
                self.least[row] = heap[0][0]

    def results(self):
        for query, heap in zip(self.queries.ids.tolist(), self.heaps, strict=True):
            for score, vec in heap:
                yield query, -vec, score


def _blocks(batch: pa.RecordBatch):
    """The vectors of a batch as a matrix of doubles; all of one cell have one dimension."""
    lists = batch.column("v")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return batch.column("vec_id").to_numpy(), flat.reshape(len(lists), -1)


def _runs(batches, names: tuple[str, ...]):
    """(key, batch) for each run of equal keys in sorted batches."""
    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
        if len(keys):
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def neighbours(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product with each query row, itself left out; ties go to the smaller vec_id.

    Queries and candidates meet in cells of a grid (block of queries, shard of candidates); cells only hold vectors of one dimension. A task holds one block of
    queries and streams its candidates. Rows that repeat a vec_id count once (the least vector); rows with a null vec_id or a vector that is not usable() take no part; an
    empty table, or one vector alone, gives no rows. Other columns are left out, so their names can't clash."""
    spark = vectors.sparkSession
    base.ship(spark)
    kind = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("v"), is_query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    size = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("queries")).first()
    blocks, shards = max(1, -(-size["queries"] // QUERY_BLOCK)), max(1, -(-size["n"] // SHARD))
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    dimension = F.size("v").cast("long").alias("dim")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("is_query").select(dimension, F.pmod(h, F.lit(blocks)).cast("int").alias("block"), spread(shards).alias("shard"), F.lit(0).alias("side"), "vec_id", "v")
    candidates = rows.select(dimension, spread(blocks).alias("block"), F.pmod(h, F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("side"), "vec_id", "v")
    cells = queries.unionByName(candidates).repartition("dim", "block", "shard").sortWithinPartitions("dim", "block", "shard", "side", "vec_id", "v")
    names = ["query_id", "vec_id", "score"]

    def search(batches):
        cell, waiting, found, last = None, [], None, None

        def out():
            if found is None:
                return
            got = list(found.results())
            for a in range(0, len(got), 10_000):
                columns = zip(*got[a:a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names)

        for key, batch in _runs(batches, ("dim", "block", "shard", "side")):
            ids, matrix = _blocks(batch)
            first = np.concatenate(([last != (key, ids[0])], ids[1:] != ids[:-1]))
            last = (key, ids[-1])
            ids, matrix = ids[first], matrix[first]
            if key[:3] != cell:
                yield from out()
                cell, waiting, found = key[:3], [], None
            if key[3] == 0:
                waiting.append((ids, matrix))
            elif waiting or found:
                if found is None:
                    found = Search(Block(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])), k)
                    waiting = []
                if len(ids):
                    found.add(Block(ids, matrix))
        yield from out()

    partial = cells.mapInArrow(search, "query_id long, vec_id long, score double")

    def merge(batches):
        query, heap = None, []

        def out(rows_):
            columns = zip(*rows_, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        ranked = lambda: [(query, n + 1, -v, s) for n, (s, v) in enumerate(sorted(heap, reverse=True))]
        for batch in batches:
            rows_ = []
            for q, v, s in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if q != query:
                    rows_ += ranked()
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                else:
                    heapq.heappushpop(heap, (s, -v))
            if rows_:
                yield out(rows_)
        if heap:
            yield out(ranked())

    return partial.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(base.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
