"""Searches and near duplicates of vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from spanloom.llm import collision_search, multi_index
from spanloom.llm.vectors import unit

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    for name in ("label", "cell", "block", "vec", "id", "score"):
        df = df.withColumn(name, df["vec_id"])
    return df


def some_vectors(n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for k in range(100, 160):  # near copies of one vector, some beyond the limit
        x[k] = x[100] + rng.standard_normal(dim).astype(np.float32) * rng.uniform(0, 0.35)
    x[200:240] = x[200]  # equal ones
    return x


AWKWARD = [(9001, None), (9002, [0.0] * 16), (9003, [NAN] + [1.0] * 15), (9004, [INF] + [1.0] * 15), (9005, [None] + [1.0] * 15), (None, [1.0] * 16), (9006, []), (9007, [1.0, 2.0])]


def test_search_finds_the_nearest(spark):
    x = some_vectors()
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = table(spark, [*rows, *AWKWARD])
    got = collision_search.search(df, df.filter("vec_id % 50 = 0"), block_rows=256).collect()
    u = unit(x.astype(np.float64))
    hits = 0
    for q in range(0, 600, 50):
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:], strict=False))
        hits += len({r.vec_id for r in mine} & set(best.tolist()))
        if q == 200:  # equal vectors: the smallest ids
            assert [r.vec_id for r in mine] == [201, 202, 203, 204, 205]
    assert hits >= 0.9 * 60 and len(got) == 60


def test_search_with_few_candidates(spark):
    df = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0])])
    got = {(r.query_id, r.rank, r.vec_id) for r in collision_search.search(df, df.filter("vec_id % 50 = 0")).collect()}
    assert got == {(0, 1, 50), (0, 2, 50), (0, 3, 1), (50, 1, 0), (50, 2, 1)}
    empty = df.limit(0)
    assert collision_search.search(empty, empty).count() == 0 and collision_search.search(df, empty).count() == 0


def brute(x, limit=0.95):
    u = unit(x.astype(np.float64))
    near = u @ u.T >= limit
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


@pytest.mark.parametrize("block", [4096, 50])
def test_near_duplicates_are_all_found(spark, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", block)
    monkeypatch.setattr(multi_index, "PART_ROWS", block * 2)
    x = some_vectors()
    df = table(spark, [*[(i, [float(a) for a in v]) for i, v in enumerate(x)], *AWKWARD])
    got = {r.vec_id: r for r in multi_index.near_duplicates(df).collect()}
    links, label = brute(x)
    for i in range(600):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], label[i], bool(label[i] == i))
    for i, _ in AWKWARD:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert len(got) == 608


def test_repeated_rows_and_empty_tables(spark):
    df = table(spark, [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [3.0, 0.0, 0.0])])
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(df).collect())
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 3, 1, False)]
    assert multi_index.near_duplicates(df.limit(0)).count() == 0


def test_walk_visits_cells_in_order_until_the_limit():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    cells = multi_index.walk(a, b, 0.9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == (a[:, None] + b[None] <= 0.9).sum()
