"""Nearest neighbours by vantage-point trees, one per shard.

The vectors are dealt to shards by a hash of their id. Each shard builds a tree: a vantage point splits its
vectors at the median distance into two halves, and each half knows its least and greatest distance. A
query skips a half when ``factor`` times the triangle inequality's lower bound exceeds its k-th best
distance so far: factor 1 is exact search, larger factors prune more and lose some recall. Distances are
Euclidean on the original vectors in double precision.

Each vector moves once, to its shard of about SHARD_BYTES; each query goes to every shard. A shard's rows arrive
sorted, vectors first: its tree is built once and the queries stream through it batch by batch, so a task holds
one shard and one batch, both bounded, and returns k rows per query. Equal vectors split by rank, so a large
group of copies stays balanced. What moves grows with the vectors, and with queries times shards, which is
what asking every shard takes.

* Vectors that are null, empty, zero or hold null or non-finite components take no part, as query or as
  candidate; so do rows without an id. Vectors of different lengths are never compared.
* A row with the query's own id is not its neighbour. Rows that repeat are candidates as often as they stand.
* Ties go to the smaller vec_id. Fewer than k candidates give fewer rows. Extra columns are ignored.
* Very long vectors make shards of fewer rows, one at least. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, scratch, stage

SHARD_BYTES, LEAF = 8 << 20, 128
FACTOR = 1.5


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        point = int(self.rng.choice(rows))
        d = np.sqrt(((self.vectors[rows] - self.vectors[point]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return point, (d[near].min(), d[near].max()), (d[far].min(), d[far].max()), self._build(rows[near]), self._build(rows[far])

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) by query, nearest first; infinite where there are fewer than k."""
        n = len(qids)
        self.best = np.full((n, k), np.inf)
        self.best_id = np.full((n, k), np.iinfo(np.int64).max)
        self.qids, self.queries, self.k, self.factor = qids, queries, k, factor
        if len(self.ids):
            self._visit(self.root, np.arange(n))
        return self.best, self.best_id

    def _visit(self, node, q: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            for a in range(0, len(q), 256):
                self._leaf(node, q[a : a + 256])
            return
        point, near, far, left, right = node
        d = np.sqrt(((self.queries[q] - self.vectors[point]) ** 2).sum(axis=1))
        first = d <= (near[1] + far[0]) / 2
        for side in (True, False):
            q1, d1 = q[first == side], d[first == side]
            order = ((left, near), (right, far)) if side else ((right, far), (left, near))
            for child, (low, high) in order:
                if len(q1):
                    bound = np.maximum(0, np.maximum(low - d1, d1 - high))
                    keep = self.factor * bound <= self.best[q1, -1] * (1 + 1e-12)
                    if keep.any():
                        self._visit(child, q1[keep])

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        ids, x, y = self.ids[rows], self.vectors[rows], self.queries[q]
        size = (y**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :]
        near = size - 2 * (y @ x.T) <= self.best[q, -1:] ** 2 + 1e-9 * size  # a superset; distances follow exactly
        near &= self.qids[q][:, None] != ids[None, :]
        some = near.any(axis=1)
        if not some.any():
            return
        q, near = q[some], near[some]
        a, b = np.nonzero(near)
        d = np.full(near.shape, np.inf)
        d[a, b] = np.sqrt(((self.queries[q[a]] - x[b]) ** 2).sum(axis=1))
        d = np.concatenate([self.best[q], d], axis=1)
        i = np.concatenate([self.best_id[q], np.broadcast_to(ids, (len(q), len(ids)))], axis=1)
        i = np.where(np.isinf(d), np.iinfo(np.int64).max, i)
        order = np.lexsort((i, d), axis=1)[:, : self.k]
        self.best[q] = np.take_along_axis(d, order, axis=1)
        self.best_id[q] = np.take_along_axis(i, order, axis=1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v an array of doubles that takes part."""
    v = F.col(vector_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _searcher(k: int, factor: float):
    """Rows (shard, dim, asks, id, v) sorted by the first three: vectors (asks 0) of a shard and dim, then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, dim, asks, ids = (batch.column(c).to_numpy() for c in ("shard", "dim", "asks", "id"))
            keys = np.stack([shard, dim, asks])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            v = batch.column("v")
            for i, j in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
                if (now := (shard[i], dim[i])) != place:
                    place, held, tree = now, [], None
                x = v.slice(i, j - i).flatten().to_numpy().reshape(j - i, dim[i])
                if not asks[i]:
                    held.append((ids[i:j].copy(), x.copy()))
                    continue
                if tree is None and held:
                    every = np.concatenate([h[0] for h in held])
                    order = np.argsort(every, kind="stable")
                    tree, held = Tree(every[order], np.concatenate([h[1] for h in held])[order]), []
                if tree is not None:
                    d, found = tree.search(ids[i:j], x, k, factor)
                    ok = np.isfinite(d)
                    yield pa.record_batch({"query_id": pa.array(np.repeat(ids[i:j], k).reshape(d.shape)[ok]), "vec_id": pa.array(found[ok]), "score": pa.array(d[ok])})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows. Both inputs are (id, v)."""
    with scratch():
        rows = stage(vectors.withColumn("dim", F.size("v")), "vp-vectors", keep=True)
        asked = stage(queries.withColumn("dim", F.size("v")), "vp-queries", keep=True)
    size = rows.agg(F.sum(F.col("dim").cast("bigint") * 8)).first()[0] or 0
    shards = max(8, -(-size // SHARD_BYTES))
    shard_of = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int")
    left = rows.select(shard_of.alias("shard"), "dim", F.lit(0).alias("asks"), "id", "v")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(1).alias("asks"), "id", "v")
    met = left.unionByName(right).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "asks")
    found = in_arrow(met, _searcher(k, factor), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, factor: float = FACTOR) -> DataFrame:
    """Contract rows: queries are the rows whose id is divisible by ``every``, each id once."""
    rows = usable(embeddings, "vec_id", "embedding")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    return search(rows, asked, k, factor)
