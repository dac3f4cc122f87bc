"""Exact top-k search by inner product (operator 5): KD-trees per shard.

A task builds a KD-tree over every shard of its rows (median splits on the widest dimension, tight bounding
boxes), GROUP shards at a time, and reads the queries from the shared folder in blocks of QUERY_BLOCK. Each
tree is searched best-first by the largest inner product that a box allows; each query's k-th score so far goes
on from tree to tree, so that later ones are cut early. A tie with the k-th score is kept for its smaller
vec_id. The k best of each group are merged by Spark. Queries never pass through the driver.

A query finds itself, too, so one more than k is searched, and one row that looks like the query's own is taken out.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, open_folder, remove_folder, shared_dir, table

K, EVERY = 10, 100
#: Queries that a task holds at once; rows of a shard; shards that a task holds at once; rows of a leaf.
QUERY_BLOCK, SHARD, GROUP, LEAF = 2048, 8192, 8, 64


class KDTree:
    """Nodes (lo, hi, left, right, first, last) over a shard's integer vectors, reordered so that a node is a range."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(ids))
        self.lo, self.hi, self.child, self.range = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            first, last, parent, side = stack.pop()
            own = vectors[self.order[first:last]]
            node = len(self.lo)
            self.lo.append(own.min(axis=0))
            self.hi.append(own.max(axis=0))
            self.child.append([-1, -1])
            self.range.append((first, last))
            if parent >= 0:
                self.child[parent][side] = node
            width = self.hi[-1] - self.lo[-1]
            axis = int(width.argmax()) if len(width) else 0
            if last - first > LEAF and width.any():
                half = (last - first) // 2
                part = np.argpartition(own[:, axis], half)
                self.order[first:last] = self.order[first:last][part]
                stack += [(first, first + half, node, 0), (first + half, last, node, 1)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)
        self.vectors, self.ids = vectors[self.order], ids[self.order]

    def search(self, query: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Improve `best`, a heap of (score, -vec_id) of at most k rows, by this shard."""
        plus, minus = np.maximum(query, 0), np.minimum(query, 0)
        bounds = self.hi @ plus + self.lo @ minus
        heap = [(-int(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(best) >= k and -bound < best[0][0]:
                break
            left, right = self.child[node]
            if left >= 0:
                for c in (left, right):
                    if len(best) < k or bounds[c] >= best[0][0]:
                        heapq.heappush(heap, (-int(bounds[c]), c))
                continue
            first, last = self.range[node]
            found = self.vectors[first:last] @ query
            at = np.flatnonzero(found >= best[0][0]) if len(best) >= k else np.arange(last - first)
            for score, vec in zip(found[at].tolist(), self.ids[first:last][at].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (score, -vec))
                elif (score, -vec) > best[0]:
                    heapq.heapreplace(best, (score, -vec))


_FOUND = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _by_length(batch: pa.RecordBatch, ids: str):
    """(ids, matrix) of the vectors of each length in a batch with columns `ids` and v."""
    column = batch.column("v")
    ends = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat, names = column.values.to_numpy(zero_copy_only=False), batch.column(ids).to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield names[at], flat[ends[at][:, None] + np.arange(size)].astype(np.int64)


def _blocks(folder: str):
    """The queries in the folder, QUERY_BLOCK at a time: their numbers and, by length, which of them and their matrix."""
    import pyarrow.dataset as ds

    store, where = open_folder(folder)
    for batch in ds.dataset(where, filesystem=store, format="parquet").to_batches(columns=["q", "v"], batch_size=QUERY_BLOCK):
        if batch.num_rows:
            row = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("v")], names=["row", "v"])
            yield batch.column("q").to_numpy(zero_copy_only=False), list(_by_length(row, "row"))


def _fitted(queries: np.ndarray, size: int) -> np.ndarray:
    """Queries against vectors of another length: what one side lacks counts as zero."""
    out = np.zeros((len(queries), size), np.int64)
    n = min(size, queries.shape[1])
    out[:, :n] = queries[:, :n]
    return out


def _searcher(folder: str, k: int):
    def searched(trees: list[KDTree]):
        for numbers, lengths in _blocks(folder):
            best: list[list] = [[] for _ in numbers]
            for tree in trees:
                for rows, queries in lengths:
                    for i, query in zip(rows.tolist(), _fitted(queries, tree.vectors.shape[1]), strict=True):
                        tree.search(query, best[i], k)
            found = [(int(numbers[i]), -v, s) for i, heap in enumerate(best) for s, v in heap]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], schema=_FOUND)

    def run(batches):
        held: dict[int, list] = {}  # by length: ids and matrices that no tree has yet
        trees: list[KDTree] = []

        def grown(size: int) -> KDTree:
            ids, vectors = zip(*held.pop(size), strict=True)
            return KDTree(np.concatenate(vectors), np.concatenate(ids))

        for batch in batches:
            for first in range(0, batch.num_rows, SHARD):
                for ids, vectors in _by_length(batch.slice(first, SHARD), "vec_id"):
                    held.setdefault(vectors.shape[1], []).append((ids, vectors))
                    if sum(len(x) for x, _ in held[vectors.shape[1]]) >= SHARD:
                        trees.append(grown(vectors.shape[1]))
                if len(trees) >= GROUP or sum(len(x) for parts in held.values() for x, _ in parts) >= GROUP * SHARD:
                    yield from searched(trees + [grown(size) for size in list(held)])
                    trees = []
        trees += [grown(size) for size in list(held)]
        if trees:
            yield from searched(trees)

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by `every`.

    Components become floor(1024 * x). Rows with a null vec_id, vector or component, or one that isn't finite,
    take no part. Every other row is a candidate of its own, and, if its vec_id is asked for, a query of its own,
    also where rows share a vec_id or are equal. Of vectors of different lengths, what one lacks counts as zero
    (an empty vector scores 0). Other columns are ignored. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    x = F.col("embedding")
    good = embeddings.where(x.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(1024.0) * c.cast("double")).cast("bigint"))
    rows = good.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))
    same = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    self_score = F.aggregate(F.transform("v", lambda c: c * c), F.lit(0).cast("bigint"), lambda a, c: a + c)
    asked = checkpointed(same.select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "copies", "v", self_score.alias("own_score")))
    folder = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    asked.select("q", "v").write.parquet(folder)
    found = rows.mapInArrow(_searcher(folder, k + 1), "q bigint, vec_id bigint, score bigint")
    order = [F.desc("score"), F.col("vec_id")]
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("place") <= k + 1)
    best = best.join(asked.drop("v"), "q")
    own = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own_score")), F.col("place"))
    best = best.withColumn("own", F.min(own).over(Window.partitionBy("q")))
    best = best.withColumn("rank", (F.col("place") - F.when(F.col("place") > F.col("own"), 1).otherwise(0)).cast("int"))
    best = best.where(F.col("own").isNull() | (F.col("place") != F.col("own"))).where(F.col("rank") <= k)
    out = best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    out = checkpointed(out)
    remove_folder(spark, folder)
    return out


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.row, q.vec_id as query_id, c.vec_id, coalesce(cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint), 0) as score
  from v q join v c on q.vec_id % 100 = 0 and c.row <> q.row),
r as (select *, cast(row_number() over (partition by row order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
