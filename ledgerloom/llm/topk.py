"""Exact top-k inner product search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block of candidates and of a block of queries; queries that a task searches for at once.
BLOCK, QUERY_BLOCK, TOGETHER = 8_192, 8_192, 512


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null if the vector or a component is null or not finite. An empty vector stays empty."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(vector.isNotNull() & good, F.transform(x, lambda v: F.floor(scale * v).cast("long")))


class SortedLists:
    """Vectors of a block with, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.asc = np.argsort(self.vectors, axis=0, kind="stable")
        self.most = int(np.abs(self.vectors).max(initial=0))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, step: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query row, id, score) of each query's ``k`` highest scores, ties to the smaller id, and how many pairs were scored.

        All queries go down the lists together, each round by twice as many entries: in every dimension from the top and
        from the bottom, since a query gains most at the end that its component's sign names. What is new is scored for
        all queries still searching in one product (of doubles while they hold every sum exactly). No vector that a
        query hasn't met scores more than the sum over dimensions of its component times the last value met at its end;
        a query stops once that bound is below its kth score.
        """
        n, dims = self.vectors.shape
        exact = dims * self.most * int(np.abs(queries).max(initial=0)) < 2**53
        kind = np.float64 if exact else np.int64
        vectors, queries = self.vectors.astype(kind), queries.astype(kind)
        gain, loss = np.maximum(queries, 0), np.minimum(queries, 0)
        active, seen, depth, scored = np.arange(len(queries)), np.zeros(n, bool), 0, 0
        ranks = np.full((len(queries), k), n, np.int64)
        best = np.zeros((len(queries), k), kind)
        while len(active) and n:
            depth, step = (min(n, depth + step), 2 * step) if dims else (n, step)
            near = np.unique(np.concatenate([self.asc[:depth].ravel(), self.asc[n - depth :].ravel()])) if 2 * depth < n else np.arange(n)
            new = near[~seen[near]]
            seen[new] = True
            scored += len(new) * len(active)
            score = queries[active] @ vectors[new].T
            allowed = self.ids[new][None, :] != own[active][:, None]
            for row, (q, s, may) in enumerate(zip(active, score, allowed, strict=True)):
                at, s = new[may], s[may]
                if len(s) > k:
                    least = np.partition(s, len(s) - k)[len(s) - k]
                    at, s = at[s >= least], s[s >= least]
                held = ranks[q] < n
                at, s = np.concatenate([ranks[q][held], at]), np.concatenate([best[q][held], s])
                top = np.lexsort((at, -s))[:k]
                ranks[q, : len(top)], best[q, : len(top)] = at[top], s[top]
            if len(near) == n:
                break
            bound = gain[active] @ vectors[self.asc[n - depth], np.arange(dims)] + loss[active] @ vectors[self.asc[depth - 1], np.arange(dims)]
            active = active[(ranks[active, -1] == n) | (bound >= best[active, -1])]
        q, turn = np.nonzero(ranks < n)
        return q, self.ids[ranks[q, turn]], best[q, turn].astype(np.int64), scored


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's ``k`` highest integer inner products with all other rows: (query_id, rank, id, score).

    Queries are blocked, and so are candidates, both by hash; each pair of blocks is one group of bounded size, searched
    with sorted lists of its own, and the groups' best rows are ranked. Ties go to the smaller id. Only vectors of equal
    length are compared. Rows with a null id, and vectors that are null or hold null or non-finite components, take no
    part; rows of a query's own id aren't its candidates; a query without candidates has no rows; repeated candidates
    each count; a repeated query id counts once, with the smallest of its vectors. Scores are exact as long as they fit
    63 bits. An empty table has no rows; other columns are ignored.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), is_query.alias("q")).where("id IS NOT NULL AND v IS NOT NULL")
    n, nq = own.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks, query_blocks = n // block + 1, nq // query_block + 1
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    cand = own.select("id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).alias("b"), each(query_blocks).alias("qb"))
    asks = own.where("q").groupBy("id").agg(F.min("v").alias("v"))
    asks = asks.select("id", "v", F.size("v").alias("d"), each(blocks).alias("b"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"))

    def search(key: tuple, asks: pa.Table, cand: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if asks.num_rows and cand.num_rows:
            dims = key[0].as_py()
            lists = SortedLists(cand["id"].to_numpy(), _matrix(cand["v"], dims))
            ids, rows = asks["id"].to_numpy(), _matrix(asks["v"], dims)
            for s in range(0, len(ids), TOGETHER):
                q, at, score, _ = lists.search(rows[s : s + TOGETHER], ids[s : s + TOGETHER], k)
                found.append((ids[s : s + TOGETHER][q], at, score))
        columns = [np.concatenate([*(f[c] for f in found), np.empty(0, np.int64)]) for c in range(3)]
        return pa.table(dict(zip(("query_id", "id", "score"), columns, strict=True)))

    keys = ["d", "b", "qb"]
    found = asks.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
