"""Exact top-k search by inner product with the threshold algorithm.

Candidates are dealt into blocks; a block holds one list of its rows for each dimension, sorted by that component. For a query the
lists are read from the end that helps it (large components where the query is positive, small ones where it is negative), rows met
get their full score, and the components reached bound the score of every row not met. When the k-th best score is above the bound,
the block is done: nothing unseen can enter, not even as a tie. Blocks are independent and their winners are merged by a window over
k rows per query and block.

Queries are dealt into blocks as well, and each block of queries meets each block of candidates as one group of bounded size, spread
by a hash of the id, so one vector that repeats in a third of the rows is no hot key.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Vectors of different lengths never
meet. An id that occurs in several rows is a query once for each different vector, and none of its rows is its candidate. Scores are
whole numbers, exact while products of components stay within 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
FIRST_DEPTH = 16
RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_vectors(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, v)`` with components floor(scale * x) as whole numbers; rows that take no part are left out."""
    double = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), double.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))


class SortedLists:
    """The rows of a block and, for each dimension, their order by its component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        # Doubles multiply faster and are exact below 2 ** 53.
        most = int(np.abs(self.rows).max(initial=0))
        self.limit = 2**53 // max(1, most * max(1, self.rows.shape[1]))
        self.doubles = self.rows.astype(np.float64)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best rows but those called ``own``; how deep the lists were read."""
        n = len(self.ids)
        exact = int(np.abs(query).max(initial=0)) <= self.limit
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = self.ids == own
        at, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            to = min(n, depth + step) if len(up) + len(down) else n
            fresh = np.zeros(n, dtype=bool)
            if len(up) + len(down):
                fresh[self.order[n - to : n - depth, up]] = True
                fresh[self.order[depth:to, down]] = True
            else:
                fresh[:] = True
            fresh &= ~met
            met |= fresh
            new = np.flatnonzero(fresh)
            got = (self.doubles[new] @ query.astype(np.float64)).astype(np.int64) if exact else self.rows[new] @ query
            at, scores = np.concatenate([at, new]), np.concatenate([scores, got])
            keep = np.lexsort((at, -scores))[:k]  # rows are in order of id
            at, scores = at[keep], scores[keep]
            depth, step = to, step * 2
            bound = int(query[up] @ self.rows[self.order[n - to, up], up] + query[down] @ self.rows[self.order[to - 1, down], down])
            if len(scores) == k and scores[-1] > bound:
                break
        return self.ids[at], scores, depth


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``(vec_id, v)`` tables of whole vectors; ties go to the smaller id."""
    blocks, query_blocks = (max(1, math.ceil(df.count() / block)) for df in (candidates, queries))

    def dealt(df: DataFrame, own: int, other: int, asks: bool) -> DataFrame:
        mine: Column = F.pmod(F.xxhash64("vec_id"), F.lit(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        rows = df.select("vec_id", "v", F.size("v").alias("dimensions"), mine.alias("mine"), F.lit(asks).alias("asks"), every.alias("every"))
        here, there = ("every", "mine") if asks else ("mine", "every")
        return rows.select("vec_id", "v", "dimensions", "asks", F.col(here).alias("block"), F.col(there).alias("query_block"))

    both = dealt(candidates, blocks, query_blocks, False).unionByName(dealt(queries.distinct(), query_blocks, blocks, True))

    def search(group: pa.Table) -> pa.Table:
        ids, asks = group["vec_id"].to_numpy(), group["asks"].to_numpy()
        flat = pa.concat_arrays([c.flatten() for c in group["v"].chunks]).to_numpy(zero_copy_only=False)
        rows = flat.reshape(len(ids), -1).astype(np.int64)
        lists, out = SortedLists(ids[~asks], rows[~asks]), []
        for own, query in zip(ids[asks], rows[asks], strict=True):
            found, scores, _ = lists.best(query, own, k)
            out.append((np.full(len(found), own), found, scores))
        parts = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(np.concatenate([np.empty(0, np.int64), *p])) for p in parts], schema=RESULT)

    found = both.groupBy("dimensions", "block", "query_block").applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
