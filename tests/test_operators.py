from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.blocks import BLOCK, NO_BLOCKS, Run, plan_blocks, running
from spanloom.operators.intervals import asof_last, count_overlaps, interval_sweep, interval_union_length, islands, overlap_pairs
from spanloom.operators.ranks import median_and_rank
from spanloom.operators.trees import expand_edges, nearest_ancestor, path_totals, roots
from tests.fixtures import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with two thirds of the rows, a third of all at one instant."""
    rng = random.Random(5)
    data = [(1, 500 if i % 2 else rng.randrange(1000), i, rng.choice([None, i])) for i in range(2000)]
    data += [(2 + i % 50, rng.randrange(1000), 5000 + i, rng.choice([None, i])) for i in range(1000)]
    return spark.createDataFrame(data, "k long, ts long, id long, v long").repartition(7).cache()


def runs():
    return {
        "total": Run("sum", F.col("v")), "n": Run("row_number"), "top": Run("max_before", F.col("v")), "back": Run("lag", F.col("v")),
        "ahead": Run("lead", F.col("id")), "seen": Run("last_before", F.col("v")), "now": Run("last", F.col("v")),
    }


def test_blocks_give_the_same_ordered_columns(skewed):
    blocks = plan_blocks(skewed, ["k"], ["ts", "id"], block_rows=100)
    assert blocks.split
    assigned = blocks.assign(skewed, "ts", "id")
    largest = assigned.groupBy("k", BLOCK).count().agg(F.max("count")).first()[0]
    assert largest < 400  # also the hot instant is cut
    order = (["k"], ["ts", "id"])
    assert rows(running(skewed, *order, runs(), blocks)) == rows(running(skewed, *order, runs(), NO_BLOCKS))


def test_blocks_without_key_and_bounded_cuts(skewed):
    blocks = plan_blocks(skewed, [], ["ts", "id"], block_rows=10, max_cuts=20)
    assert sum(len(g) for r in blocks.table.collect() for g in r["_groups"]) <= 40
    assert rows(running(skewed, [], ["ts", "id"], runs(), blocks)) == rows(running(skewed, [], ["ts", "id"], runs(), NO_BLOCKS))


def test_rows_with_a_null_key_stay(skewed):
    df = skewed.withColumn("k", F.when(F.col("k") > 4, F.col("k")))
    blocks = plan_blocks(df, ["k"], ["ts", "id"], block_rows=20)
    assert rows(running(df, ["k"], ["ts", "id"], runs(), blocks)) == rows(running(df, ["k"], ["ts", "id"], runs(), NO_BLOCKS))


def test_small_input_is_not_cut(skewed):
    assert not plan_blocks(skewed, ["k"], ["ts"]).split


@pytest.mark.parametrize(
    "spans, active, peak",
    [([[6, 7], [0, 10], [3, 8]], 10, 3), ([[0, 1], [1, 2]], 2, 1), ([], None, None), ([[0, 4], [0, 4]], 4, 2), ([[2, 2]], None, None), ([[5, 9], [1, 3]], 6, 1)],
)
def test_union_length_goldens(spark, spans, active, peak):
    df = spark.createDataFrame([(1, a, b) for a, b in spans], "k long, ts long, end_ts long")
    assert rows(interval_union_length(df, ["k"])) == ([] if active is None else [(1, active, peak)])


def test_sweep_against_midpoint_coverage(spark):
    rng = random.Random(302610)
    data = []
    for key in range(500):
        for _ in range(rng.randrange(16)):
            start = rng.randrange(40)
            data.append((key, start, start + rng.randrange(12)))
    want = {}
    for key in {d[0] for d in data}:
        mine = [(a, b) for k, a, b in data if k == key and b > a]
        cover = [sum(a <= x < b for a, b in mine) for x in range(60)]
        if mine:
            want[key] = (sum(c > 0 for c in cover), max(cover))
    df = spark.createDataFrame(data, "k long, ts long, end_ts long")
    for blocks in (NO_BLOCKS, plan_blocks(df, ["k"], ["ts"], block_rows=20)):
        got = {k: (a, p) for k, a, p in rows(interval_union_length(df, ["k"], blocks=blocks))}
        assert got == want


def test_global_sweep_in_blocks(spark):
    rng = random.Random(1)
    data = [(a := rng.randrange(5000), a + rng.randrange(1, 300), i % 2) for i in range(800)]
    df = spark.createDataFrame(data, "ts long, end_ts long, odd long").withColumn("even", 1 - F.col("odd"))
    one = rows(interval_sweep(df, [], ["odd", "even"], blocks=NO_BLOCKS))
    cut = rows(interval_sweep(df, [], ["odd", "even"], blocks=plan_blocks(df, [], ["ts"], block_rows=50)))
    assert one == cut and one[-1][2:] == (0, 0)


def test_islands_touching_rows_open_a_new_group(spark):
    df = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 7), (1, 3, 10, 12), (1, 4, 11, 20)], "k long, id long, s long, e long")
    assert rows(islands(df, ["k"], start="s", end="e", tie="id"), "id", "cluster_id") == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_asof_and_overlap_counts_against_brute_force(spark):
    rng = random.Random(9)
    left = [(i, i % 3, a := rng.randrange(100), a + rng.choice([0, 0, 3, 9])) for i in range(150)]
    right = [(1000 + i, i % 3, a := rng.randrange(100), a + rng.choice([0, 2, 5])) for i in range(150)]
    cols = "id long, k long, ts long, end_ts long"
    l, r = spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)

    def overlap(x, y):
        (a, b), (c, d) = x, y
        if a < b and c < d:
            return a < d and c < b
        if a == b and c == d:
            return a == c
        return c <= a < d if a == b else a <= c < b

    want_n, want_asof = [], []
    for i, k, a, b in left:
        hits = [j for j, kk, c, d in right if kk == k and overlap((a, b), (c, d))]
        want_n.append((i, len(hits), hits[0] if len(hits) == 1 else None))
        before = [(c, j) for j, kk, c, _ in right if kk == k and c <= a]
        want_asof.append((i, max(before)[1] if before else None))
    pairs = sorted((k, i, j) for i, k, a, b in left for j, kk, c, d in right if kk == k and overlap((a, b), (c, d)))
    for cell in (2_000, 3):
        assert rows(overlap_pairs(l, r, ["k"], cell_rows=cell)) == pairs
    assert overlap_pairs(l.limit(0), r, ["k"]).count() == 0 and overlap_pairs(l, r.limit(0), ["k"]).columns == ["k", "left_id", "right_id"]
    for rows_per_block in (10**6, 20):
        both = l.unionByName(r)
        blocks = plan_blocks(both, ["k"], ["ts"], block_rows=rows_per_block)
        assert rows(count_overlaps(l, r, ["k"], blocks=blocks)) == sorted(want_n)
        found = asof_last(l, r, ["k"], left_ts="ts", right_ts="ts", right_tie="id", value=F.col("id"), out="rid", blocks=blocks)
        assert rows(found, "id", "rid") == sorted(want_asof)


def test_exact_ranks_equal_builtin_percentiles(spark):
    rng = random.Random(3)
    data = [(None if i % 9 == 0 else i % 3, rng.randrange(50), rng.choice([None, rng.randrange(30)])) for i in range(600)]
    df = spark.createDataFrame(data, "a long, b long, v long")
    small = rows(median_and_rank(df, ["a"], "v", 95, rows=600))
    cut = rows(median_and_rank(df, ["a"], "v", 95, rows=600, block_rows=40))
    assert [tuple(map(lambda x: None if x is None else float(x), r)) for r in small] == [
        tuple(map(lambda x: None if x is None else float(x), r)) for r in cut
    ]


def test_deep_chain_needs_few_rounds(spark):
    chain = spark.range(10_001).selectExpr("id", "if(id = 0, null, id - 1) as parent_id")
    found = nearest_ancestor(chain, is_stop=F.col("id") == 0)
    assert found.count() == 10_001 and rows(found.select("ancestor_id").distinct()) == [(0,)]


def test_cycles_and_missing_parents_reach_nothing(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 4), (6, 99)], "id long, parent_id long")
    assert rows(roots(nodes)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6)]


def test_path_carry_and_totals(spark):
    nodes = spark.createDataFrame([(1, None, 7, True), (2, 1, 3, False), (3, 2, None, False), (4, 3, 9, False)], "id long, parent_id long, v long, stop boolean")
    carried = nearest_ancestor(nodes, is_stop=F.col("stop"), carry={"low": ("min", F.col("v")), "high": ("max", F.col("v"))})
    assert rows(carried) == [(1, 1, None, None), (2, 1, 3, 3), (3, 1, 3, 3), (4, 1, 3, 9)]
    assert rows(path_totals(nodes, {"top": F.col("v")})) == [(1, 7), (2, 7), (3, 7), (4, 9)]


def test_expand_edges_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "parent_id long, id long")
    seeds = spark.createDataFrame([(1,)], "seed long")
    assert rows(expand_edges(edges, seeds)) == [(1, 1, 0), (1, 2, 1), (1, 3, 1)]


def test_descendant_totals_of_forests_and_rings(spark):
    from spanloom.operators.trees import descendant_totals

    rng = random.Random(11)
    parent = {i: (None if rng.random() < 0.1 else rng.randrange(120)) for i in range(120)}
    parent |= {200 + i: 200 + (i + 1) % 500 for i in range(500)} | {900: 205, 901: 900, 902: 5000}  # a ring with a tail, a missing parent
    df = spark.createDataFrame(list(parent.items()), "id long, parent_id long")
    below = {i: {i} for i in parent}
    for i in parent:
        seen, p = {i}, parent[i]
        while p in parent and p not in seen:
            below[p].add(i)
            seen.add(p)
            p = parent[p]
    got = rows(descendant_totals(df, {"n": F.lit(1), "s": F.col("id")}))
    assert got == sorted((i, len(b), sum(b)) for i, b in below.items())


def test_reachable_sessions_of_forests_and_graphs(spark):
    from spanloom.plans import ingest

    for links in ([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7)], [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 7)]):
        df = spark.createDataFrame(links, "parent long, child long")
        known = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 6)], "session long")
        seeds = spark.createDataFrame([(i,) for i in (1, 4, 5, 6, 9, 9)], "session long")
        got = rows(ingest.reachable_sessions(df, seeds, known))
        want = []
        for seed in (1, 4, 5, 6, 9):
            seen, todo = set(), [seed]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [c for p, c in links if p == x and x in (1, 2, 3, 4, 6)]
            want.append((seed, len(seen & {1, 2, 3, 4, 6}), len(seen - {1, 2, 3, 4, 6})))
        assert got == want
