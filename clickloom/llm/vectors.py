"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt to shards by a hash of their id, so any cluster is spread evenly. Each shard's task builds a KD-tree
(median splits of the widest dimension, tight bounding boxes) and walks it best-first for each query: the bound of a
box is the largest inner product it can hold, and the walk ends when the best bound is below the k-th score so far.
A query first visits one shard; its k-th score there is passed on and cuts the walks in all other shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import Scratch, query, table

SHARD_ROWS, LEAF_ROWS = 4096, 64


def scaled(vector: Column) -> Column:
    """floor(1024 x) of each component; null for a null vector and for one with a null or non-finite component."""
    v = vector.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(v, lambda x: F.floor(x * 1024.0).cast("double")))


class Tree:
    """A KD-tree over rows of integers (as doubles)."""

    def __init__(self, points: np.ndarray):
        self.points, self.rows, self.low, self.high, self.kids = points, [], [], [], []
        if len(points):
            self._grow(np.arange(len(points)))
            self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray) -> int:
        p, at = self.points[rows], len(self.rows)
        self.low.append(p.min(axis=0))
        self.high.append(p.max(axis=0))
        self.rows.append(rows)
        self.kids.append(())
        width = self.high[at] - self.low[at]
        if len(rows) > LEAF_ROWS and width.size and width.max() > 0:
            axis, half = int(width.argmax()), len(rows) // 2
            order = np.argpartition(p[:, axis], half)
            self.kids[at] = (self._grow(rows[order[:half]]), self._grow(rows[order[half:]]))
        return at

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.low * q, self.high * q).sum(axis=1)

    def search(self, q: np.ndarray, own, ids: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, id), ties to smaller ids, among scores of at least ``floor``; never the query's own id."""
        if not len(self.points):
            return []
        bounds = self.bounds(q)
        best: list[tuple[float, int]] = []  # a heap of (score, -id): the worst on top
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor or (len(best) == k and -bound < best[0][0]):
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(queue, (-bounds[kid], kid))
                continue
            rows = self.rows[node]
            scores = self.points[rows] @ q
            least = max(floor, best[0][0]) if len(best) == k else floor
            for j in np.flatnonzero(scores >= least):
                i = int(ids[rows[j]])
                if i == own:
                    continue
                item = (float(scores[j]), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in best]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, -1) if rows else np.zeros((0, 0))


def _exact_scores(points: np.ndarray, q: np.ndarray) -> list[int]:
    """Python integers, for components so large that doubles would round; cut to the range of a long."""
    a, b = points.astype(object), q.astype(object)
    return [min(max(sum(int(x) * int(y) for x, y in zip(r, b, strict=True)), -(2**63)), 2**63 - 1) for r in a]


def _search(k: int):
    def run(key, vectors, queries):
        ids = vectors.column("vec_id").to_numpy()
        points = _matrix(vectors.column("v"), len(ids))
        q_ids, floors = queries.column("query_id").to_numpy(), queries.column("floor").to_pylist()
        q_points = _matrix(queries.column("v"), len(q_ids))
        out: list[tuple[int, int, int]] = []
        if len(ids) and len(q_ids):
            top = max(1.0, float(np.abs(points).max(initial=0))) * max(1.0, float(np.abs(q_points).max(initial=0)))
            small = top * max(1, points.shape[1]) < 2.0**53
            tree = Tree(points) if small else None
            for q_id, floor, q in zip(q_ids, floors, q_points, strict=True):
                if small:
                    found = tree.search(q, q_id, ids, k, -np.inf if floor is None else float(floor))
                else:
                    scores = _exact_scores(points, q)
                    found = heapq.nsmallest(
                        k, ((s, int(i)) for s, i in zip(scores, ids, strict=True) if i != q_id), key=lambda x: (-x[0], x[1])
                    )
                out += [(int(q_id), int(i), int(s)) for s, i in found]
        return pa.table({
            n: pa.array([r[j] for r in out], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))
        })

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    ``vectors(vec_id, v)`` and ``queries(query_id, v)`` hold ``scaled`` vectors. Null vectors and null ids take no part;
    vectors are only compared with queries of their length. Rows with a query's id are its own and left out; other
    repeated rows count each; a repeated query is answered once. Scores beyond a long are cut to its range.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    dim = F.size("v")
    vectors = scratch.write(vectors.where("v IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "v", dim.alias("dim")))
    queries = scratch.write(
        queries.where("v IS NOT NULL AND query_id IS NOT NULL").select("query_id", "v", dim.alias("dim")).distinct()
    )
    shards = scratch.write(vectors.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards")))
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
    dealt = scratch.write(vectors.join(shards, "dim").withColumn("shard", shard).drop("shards"))
    asked = scratch.write(queries.join(shards, "dim"))
    scratch.drop(vectors, queries)
    home = F.pmod(F.xxhash64("query_id"), F.col("shards")).cast("int")
    schema = "query_id long, vec_id long, score long"

    def visit(which: DataFrame) -> DataFrame:
        which = which.select("query_id", "v", "dim", "shard", "floor")
        return dealt.groupBy("dim", "shard").cogroup(which.groupBy("dim", "shard")).applyInArrow(_search(k), schema)

    first = scratch.write(visit(asked.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long"))))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = asked.join(kth, "query_id", "left").withColumn(
        "shard", F.explode(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != home))
    )
    second = visit(others)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.union(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op9_top_k", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("v"))
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return top_k(vectors, queries, 10)
