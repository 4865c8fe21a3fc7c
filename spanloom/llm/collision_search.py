"""Nearest neighbours by collision counting over single projections.

Every vector has ``m`` numbers, its projections on random directions; each
projection of a block of rows is a sorted array.  A query opens a window around
its own number in each array; a row inside the window of a projection collides
there.  Windows grow by virtual rehashing (their width is multiplied, arrays
stay as they are) until enough rows have collided often enough, and only those
rows are verified with their exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from spanloom.llm.common import kept
from spanloom.llm.vectors import matrix, unit, usable_rows


def directions(dim: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Projections:
    """Sorted arrays of a block of rows and the collision search over them."""

    def __init__(self, x: np.ndarray, m: int):
        self.x, self.n = unit(x), len(x)
        self.a = directions(x.shape[1], m)
        p = self.x @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(p, self.order.T, axis=0).T.copy()

    def collisions(self, q: np.ndarray, half: float) -> np.ndarray:
        """Number of projections in which each row lies within ``half`` of the query."""
        count = np.zeros(self.n, dtype=np.int32)
        for k in range(len(q)):
            a, b = np.searchsorted(self.sorted[k], (q[k] - half, q[k] + half))
            count[self.order[k, a:b]] += 1  # a row is once in each array
        return count

    def search(self, query: np.ndarray, k: int, half: float, growth: float, share: float) -> np.ndarray:
        """Rows whose collisions exceed the threshold at the first window with ``k`` of them, or all rows if fewer."""
        q = query @ self.a
        need = share * len(q)
        while True:
            found = np.flatnonzero(self.collisions(q, half) >= need)
            if len(found) >= min(k, self.n) or half > 1e3:
                return found
            half *= growth


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = 128, half: float = 1.0, growth: float = 1.15, share: float = 0.56,
    block_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the largest cosine found for every query.

    Rows and queries are cut into blocks of fixed size; every block of queries
    meets every block of rows, gives its ``k`` best verified rows, and the best
    over all blocks are kept, ties to the smaller id.  All rows that reach the
    threshold are verified, however many share one place.  A query is not its
    own neighbour (rows with its id are left out).  Vectors that are null, zero
    or hold null or non-finite components take no part, nor do null ids, nor
    rows of another length than the query's.  Repeated rows are single
    candidates each.  Empty inputs give an empty result.
    """
    spark = vectors.sparkSession
    rows = kept(usable_rows(vectors, id_col, vec_col).withColumn("dim", F.size("vec")), "knn-rows")
    asked = kept(usable_rows(queries, id_col, vec_col).dropDuplicates(["id"]).withColumn("dim", F.size("vec")), "knn-queries")
    n, nq = rows.count(), asked.count()
    row_blocks, query_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(nq / block_rows))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks)).cast("int"))
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    to_all = asked.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int"))
    to_all = to_all.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in columns}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        index, ids = Projections(matrix(left["vec"]), m), left["id"].to_numpy(np.int64)
        out = []
        for qid, q in zip(right["id"].to_numpy(np.int64), unit(matrix(right["vec"])), strict=True):
            own = int((ids == qid).sum())
            found = index.search(q, k + own, half, growth, share)
            found = found[ids[found] != qid]
            score = (index.x[found] * q).sum(axis=1)
            best = np.lexsort((ids[found], -score))[:k]
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[found][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    key = ["block", "part", "dim"]
    near = placed.groupBy(*key).cogroup(to_all.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")
