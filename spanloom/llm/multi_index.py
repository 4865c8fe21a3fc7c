"""Near duplicates of vectors by an inverted multi-index.

Both halves of the unit vectors have a codebook of their own; a vector lies in
the cell (i, j) of its nearest centroids, so two small codebooks make a fine
grid.  A probe visits cells by the multi-sequence order: the pair of sorted
lists of the halves is walked from the smallest sum on.  The sum used is the
squared distance from the probe to the cell's two Voronoi regions (a lower
bound), so when it passes the squared radius no further cell can hold a partner
and the walk would end at a recall of 1.  Partners lie far below that bound: where
the walk ends for a smaller target recall is measured on partners at the limit of
the similarity, in random directions from sampled vectors.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import components, kept
from spanloom.llm.vectors import matrix, unit, usable_rows

BLOCK_ROWS, PART_ROWS, SLICE = 4096, 8192, 1024
MAX_CENTROIDS = 1024
#: Partners of sampled vectors on which the end of the walks is measured.
REACH_ROWS = 4096
#: Rows of a cell, about, until the codebooks have their largest size.
CELL_ROWS = 16


def train_codebook(x: np.ndarray, k: int, seed: int, steps: int = 10) -> np.ndarray:
    """k-means centroids; fewer rows than ``k`` give fewer centroids."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(steps):
        near = squared(x, c).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None], 0)


def region_bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared lower bound of the distance from each row to each centroid's region.

    A point of region ``i`` is no nearer to any ``j`` than to ``i``; the distance
    to that half space is ``(d_i^2 - d_j^2) / (2 |c_i - c_j|)``.
    """
    d = squared(x, c)
    apart = np.sqrt(squared(c, c))
    np.fill_diagonal(apart, np.inf)
    out = np.zeros_like(d)
    for j in range(len(c)):
        np.maximum(out, (d - d[:, j : j + 1]) / (2 * np.maximum(apart[:, j], 1e-12)), out=out)
    return out**2


def walk(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells in order of ``first[i] + second[j]`` up to ``limit``: the multi-sequence traversal."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    u, v = first[a].tolist(), second[b].tolist()
    out, heap, pushed = [], [(u[0] + v[0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            break
        out.append((int(a[i]), int(b[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(u) and q < len(v) and (p, q) not in pushed:
                pushed.add((p, q))
                heapq.heappush(heap, (u[p] + v[q], p, q))
    return out


class MultiIndex:
    """The two codebooks and the places of cells in blocks."""

    def __init__(self, sample: np.ndarray, k: int):
        u = unit(sample)
        self.half = u.shape[1] // 2
        self.books = [train_codebook(u[:, : self.half], k, 1), train_codebook(u[:, self.half :], k, 2)]
        self.shape = (len(self.books[0]), len(self.books[1]))

    def halves(self, u: np.ndarray) -> list[np.ndarray]:
        return [u[:, : self.half], u[:, self.half :]]

    def cells(self, u: np.ndarray) -> np.ndarray:
        i, j = (squared(x, c).argmin(axis=1) for x, c in zip(self.halves(u), self.books, strict=True))
        return i * self.shape[1] + j

    def reach(self, u: np.ndarray, cosine: float, target_recall: float, seed: int = 9) -> float:
        """The sum up to which a walk finds this share of partners whose cosine is just the smallest one."""
        certain = 2 - 2 * cosine + 1e-9
        if target_recall >= 1 or not len(u) or u.shape[1] < 2:
            return certain
        u = np.resize(u, (REACH_ROWS, u.shape[1]))  # several directions from each of few vectors
        away = np.random.default_rng(seed).standard_normal(u.shape)
        away -= (away * u).sum(axis=1, keepdims=True) * u
        y = cosine * u + math.sqrt(1 - cosine**2) * unit(away)
        total = np.zeros(len(u))
        for x, z, c in zip(self.halves(u), self.halves(y), self.books, strict=True):
            total += region_bounds(x, c)[np.arange(len(u)), squared(z, c).argmin(axis=1)]
        return min(certain, float(np.quantile(total, target_recall)) + 1e-9)

    def visits(self, u: np.ndarray, limit: float):
        bounds = [region_bounds(x, c) for x, c in zip(self.halves(u), self.books, strict=True)]
        for a, b in zip(*bounds, strict=True):
            yield [i * self.shape[1] + j for i, j in walk(a, b, limit)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reached) with the components of the given edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.95, target_recall: float = 0.9999, sample_rows: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Two vectors link when their cosine in double precision is at least
    ``cosine``.  Vectors that are null, zero or hold null or non-finite
    components, and rows with a null id, link with nothing and are their own
    component; vectors of different lengths never link.  Equal vectors are one
    class that is compared once and counted with its number of rows; near copies
    are counted block by block, and each block gives a spanning forest instead
    of its links.  Codebooks are fitted on at most ``sample_rows`` classes chosen
    by hash, and the end of the walks on at most ``REACH_ROWS`` of these; every row
    is indexed.  A cell with a third of all rows is cut into
    blocks, and the probes of a block into parts, of fixed size.
    """
    rows = usable_rows(vectors, id_col, vec_col)
    grouped = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = kept(grouped.select(F.monotonically_increasing_id().alias("cls"), "rep", "copies", "vec", F.size("vec").alias("dim")), "imi-classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = None
    for dim, n in sorted(sizes.items()):
        one = _links(classes.filter(F.col("dim") == dim), n, cosine, target_recall, sample_rows)
        found = one if found is None else found.union(one)
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = kept(found, "imi-links")
    count = found.filter("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("links"))
    parts = components(found.filter("kind = 1").select("a", "b"))
    of = classes.join(parts, classes["cls"] == parts["node"], "left").select("cls", "rep", "copies", "vec", F.coalesce("component", "cls").alias("part"))
    low = of.groupBy("part").agg(F.min("rep").alias("component_id"))
    known = of.join(low, "part").join(count, "cls", "left")
    known = known.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    out = ids.join(known, (ids["vec"] == known["vec"]) & ids["vec_id"].isNotNull(), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, n: int, cosine: float, target_recall: float, sample_rows: int) -> DataFrame:
    """Rows (0, class, rows of other classes linked) and (1, class, class) for classes of one dimension."""
    k = min(MAX_CENTROIDS, max(4, 2 ** round(math.log2(math.sqrt(max(1, n) / CELL_ROWS)))))
    pick = classes if n <= sample_rows else classes.filter(F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    sample = matrix(pick.orderBy(F.xxhash64("cls"), "cls").limit(2 * sample_rows).select("vec").toPandas()["vec"])
    index = MultiIndex(sample, k)
    limit = index.reach(unit(sample)[:REACH_ROWS], cosine, target_recall)

    def place(batches):
        for pdf in batches:
            yield pd.DataFrame({"cls": pdf["cls"], "copies": pdf["copies"], "vec": pdf["vec"], "cell": index.cells(unit(matrix(pdf["vec"])))})

    homes = kept(classes.select("cls", "copies", "vec").mapInPandas(place, "cls long, copies long, vec array<double>, cell int"), "imi-homes")
    # cells in order are dealt to blocks; a large cell has several of its own (at most MAX_CENTROIDS ** 2 rows)
    counts = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("cell")
    first, blocks = np.zeros(index.shape[0] * index.shape[1], dtype=np.int32), np.zeros(index.shape[0] * index.shape[1], dtype=np.int32)
    at, held = 0, 0
    for cell, rows in zip(counts["cell"], counts["n"], strict=True):
        if held and held + rows > BLOCK_ROWS:
            at, held = at + 1, 0
        first[cell], blocks[cell] = at, max(1, math.ceil(rows / BLOCK_ROWS))
        held += rows
        if blocks[cell] > 1:
            at, held = at + blocks[cell], 0

    def block_of(batches):
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            pdf["block"] = first[cell] + (pdf["cls"].to_numpy() * 2654435761 % (1 << 32)) % blocks[cell]
            yield pdf

    def probe(batches):
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                part = pdf.iloc[k : k + 2000]
                out_cls, out_vec, out_block, out_cells = [], [], [], []
                for cls, vec, cells in zip(part["cls"], part["vec"], index.visits(unit(matrix(part["vec"])), limit), strict=True):
                    by_block: dict[int, list[int]] = {}
                    for c in cells:
                        for b in range(first[c], first[c] + blocks[c]):
                            by_block.setdefault(int(b), []).append(c)
                    for b, some in by_block.items():
                        out_cls.append(cls)
                        out_vec.append(vec)
                        out_block.append(b)
                        out_cells.append(some)
                yield pd.DataFrame({"cls": out_cls, "vec": out_vec, "block": out_block, "cells": out_cells})

    homes_in = homes.mapInPandas(block_of, "cls long, copies long, vec array<double>, cell int, block int")
    probes = homes.select("cls", "vec").mapInPandas(probe, "cls long, vec array<double>, block int, cells array<int>")
    probes = kept(probes, "imi-probes")
    parts = probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    parts = kept(parts, "imi-parts")
    left = homes_in.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cls", "copies", "vec", "cell")
    right = probes.join(parts, "block").select("block", F.pmod(F.xxhash64("cls", F.lit(3)), "parts").cast("int").alias("part"), "cls", "vec", "cells")

    def meet(home: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"kind": np.zeros(0, np.int32), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})]
        if len(home) and len(asked):
            home = home.sort_values("cell", kind="stable")
            hu, cells, hid, copies = unit(matrix(home["vec"])), home["cell"].to_numpy(), home["cls"].to_numpy(), home["copies"].to_numpy()
            au, aid = unit(matrix(asked["vec"])), asked["cls"].to_numpy()
            lists = asked["cells"].to_list()
            who, cell = np.repeat(np.arange(len(asked)), [len(x) for x in lists]), np.concatenate([np.asarray(x) for x in lists])
            order = np.argsort(cell, kind="stable")
            who, cell = who[order], cell[order]
            links = np.zeros(len(asked), dtype=np.int64)
            for c in np.unique(cells):
                p, q = np.searchsorted(cells, (c, c + 1))
                r, s = np.searchsorted(cell, (c, c + 1))
                for k in range(r, s, SLICE):
                    probes_here = who[k : min(s, k + SLICE)]
                    i, j = np.nonzero(au[probes_here] @ hu[p:q].T >= cosine)
                    a, b = aid[probes_here[i]], hid[p:q][j]
                    other = a != b
                    if other.any():
                        np.add.at(links, probes_here[i[other]], copies[p:q][j[other]])
                        x, y = forest(a[other], b[other])
                        out.append(pd.DataFrame({"kind": 1, "a": x, "b": y}))
            hit = links > 0
            out.append(pd.DataFrame({"kind": 0, "a": aid[hit], "b": links[hit]}))
        return pd.concat(out, ignore_index=True).astype({"kind": "int32", "a": "int64", "b": "int64"})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, "kind int, a long, b long")
