"""Ranked search, whitening and source mixing against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import lexical_search, source_mix, whitening
from tests.llm.cases import documents, words

NAN, INF = float("nan"), float("inf")


# --- ranked search


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, top=20):
    """docs: (doc_id, text) rows; items: {id: text}."""
    counts = [(i, Counter(fold(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(k for _, _, k in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items.items():
        scored = []
        for i, c, k in counts:
            m = 75 + 25 * k * n // length
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in Counter(fold(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if absent else i, -s) for rank, (s, absent, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard,round_terms,short", [(256, 100_000, 64), (16, 40, 3)])
def test_search_equals_brute_force(spark, monkeypatch, shard, round_terms, short):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "ROUND_TERMS", round_terms)
    monkeypatch.setattr(lexical_search, "SHORT", short)
    rng = random.Random(4)
    common, rare = ["the", "of", "in", "that", "it"], words(8, 400)
    texts = [(i, " ".join(rng.choices(common, k=rng.randint(1, 30)) + rng.sample(rare, rng.randint(0, 25)))) for i in range(300)]
    texts += [(300 + i, texts[5][1]) for i in range(40)]  # ties beyond the last place
    texts += [(None, texts[5][1]), (7, texts[7][1]), (900, None), (901, ""), (902, " .,;\n"), (903, "THE The tHeÜü 12a"), (904, " ".join(rng.choices(rare, k=20_000)))]
    items = {i: " ".join(rng.choices(common, k=6) + rng.sample(rare, 8)) for i in range(12)} | {20: texts[5][1] + " the the", 21: "the", 22: "nowhere", 23: "", 24: "Üü12A ÜÜ tHeÜü"}
    df = documents(spark, texts)
    bench = spark.createDataFrame([*items.items(), (None, "the"), (25, None), (3, items[3])], "item_id long, text string").withColumn("term", df_lit())
    assert found(lexical_search.search(df, bench)) == brute_search(texts, items)


def test_the_index_is_written_in_small_row_groups(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 8)
    monkeypatch.setattr(lexical_search, "GROUP_BYTES", 64 << 10)
    rng = random.Random(5)
    rare = words(8, 400)
    df = documents(spark, [(i, " ".join(rng.choices(rare, k=300))) for i in range(400)]).coalesce(1)
    vocabulary = sorted(w.encode() for w in rare)
    counted = lexical_search._counted(df, "doc_id", "text", vocabulary)
    index = lexical_search._index(counted, [1000] * len(vocabulary), 400, 120_000, [(0, 1), (2, 3)])
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{index._table.removeprefix('file:')}/*.parquet")]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 50
    # one shard takes about 20 KB: a group ends with the shard that fills it
    assert max(g.total_byte_size for g in groups) < 128 << 10 and len(groups) > 8
    assert sorted(i for r in index.select("ids").collect() for i in r.ids) == list(range(400))


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_search_of_awkward_and_empty_tables(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    items = {1: "one two three a b", 2: rows[0][1]}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert found(lexical_search.search(df, bench)) == brute_search(rows, items)
    assert lexical_search.search(df.limit(0), bench).count() == 0 and lexical_search.search(df, bench.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "one two"), (1, "three a b")], "item_id long, text string")
    assert found(lexical_search.search(df, two, top=3)) == brute_search(rows, {1: items[1]}, 3)


def test_pair_bounds_are_tighter_and_never_too_low(spark):
    """A document's share of a unit never exceeds the unit's bound, and the bound is at most the sum of the term maxima."""
    import pyarrow as pa

    rows = {"ids": [1, 2, 3], "term": [0, 1], "start": [0, 2, 4], "doc": [0, 1, 1, 2], "impact": [9, 1, 2, 8], "top": [9, 8], "pair": [5], "pair_start": [0, 1], "pair_doc": [1], "joint": [3], "pair_top": [3]}
    batch = pa.RecordBatch.from_arrays([pa.array([rows[n]], pa.list_(k)) for n, k in zip(lexical_search._NAMES, lexical_search._KINDS, strict=True)], list(lexical_search._NAMES))
    shard = lexical_search.Shard(batch, 0)
    assert shard.bound((5, 0, 1), {0: 1, 1: 1}) == 9  # both maxima together would be 17
    assert shard.bound((5, 0, 1), {0: 1, 1: 3}) == 24 and shard.bound((6, 0, 1), {0: 1, 1: 1}) == 9 and shard.bound((None, 1), {1: 2}) == 16
    query = lexical_search.Query(1, {0: 1, 1: 1})
    for least in range(12):
        docs, scores = lexical_search.search_shard(shard, query, [(5, 0, 1)], least)
        assert dict(zip(docs.tolist(), scores.tolist(), strict=True)) == {d: s for d, s in enumerate([9, 3, 8]) if s >= max(1, least)}


# --- whitening


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("x", "n", "component", "label", "y0"):
        df = df.withColumn(name, df["vec_id"])
    return df


def check_whitened(got, x, ids, wanted):
    x = np.floor(1024 * x.astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    centred = x - np.array(sums) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    by = defaultdict(dict)
    for r in got:
        by[r.component].setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, min(wanted, x.shape[1]) + 1)) and len(got) == n * len(by)
    for c, rows in by.items():
        want = centred @ q[:, c - 1] / math.sqrt(e[c - 1])
        mine = np.array([rows[i][0].whitened for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
        for i, row in zip(ids, x, strict=True):
            r = rows[i][0]
            assert r.n == n and r.deviation == sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True))
            assert abs(r.explained / (e[c - 1] / e.sum()) - 1) < 1e-10 and r.identity_error < 1e-9


@pytest.mark.parametrize("dim,n", [(64, 700), (6, 50)])
def test_whitening_equals_the_eigenvectors(spark, dim, n):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((n, dim)) * np.linspace(0.2, 0.6, dim)).astype(np.float32)
    x[10:20] = x[10]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    bad = [(9001, None), (9002, [NAN] + [1.0] * (dim - 1)), (9003, [INF] * dim), (9004, [None] + [1.0] * (dim - 1)), (9005, []), (9006, [1.0, 2.0]), (9007, [3e30] * dim)]
    check_whitened(whitening.whiten(vectors(spark, rows + bad)).collect(), x, range(n), 8)


def test_whitening_keeps_zero_vectors_null_ids_and_repeated_rows(spark):
    got = whitening.whiten(vectors(spark, [(None, [0.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])).collect()
    assert Counter((r.vec_id, r.component) for r in got) == {(None, 1): 1, (None, 2): 1, (1, 1): 2, (1, 2): 2, (2, 1): 1, (2, 2): 1}
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 1.0]), (2, [1.0, 1.0])])).collect()  # no variance at all
    assert {(r.vec_id, r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(i, c, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(9)])).collect()  # one direction only
    assert all((r.whitened is None) == (r.component == 2) for r in line)
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0 and whitening.whiten(vectors(spark, [(1, None)]).limit(0)).count() == 0


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 40, 100_000], [100_000, 100_000]], dtype=np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert whitening._deviations(x, 2, sums) == [None, None]
    assert whitening._deviations(x[1:], 1, [100_001, 99_998]) == [5]


# --- mixing


def brute_targets(sizes, order):
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    whole, capped = sum(sizes.values()), set()
    while True:
        w = sum(weight[s] for s in order if s not in capped)
        share = (whole - sum(3 * sizes[s] for s in capped)) / w if w else 0.0
        above = {s for s in order if s not in capped and weight[s] * share > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * share for s in order}
        capped |= above


def mix_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = rng.choice(["b", "b", "b", "a", "ü", "z", None, "", "tiny"]) if i else "b"
        rows.append((i, " ".join(["w"] * (rng.choice([0, 1, 3, 3, 7, 30]) if source != "tiny" else 1)), source))
    rows += [(1000 + i, "x y z", "b") for i in range(600)]  # equal texts in one source
    rows += [(2000, None, "nul"), (2001, "", "nul"), (None, "a b", "a"), (5000, "a b", "a"), (5000, "a b", "a"), (3000, "w " * 20_000, "ü"), (3001, "a b\tc\x1cd\n\x0be", "z")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id AS size", "1 AS h", "1 AS part", "1 AS taken", "1 AS docs")


@pytest.mark.parametrize("range_rows", [10_000, 20])
def test_mix_meets_its_targets(spark, monkeypatch, range_rows):
    monkeypatch.setattr(source_mix, "RANGE_ROWS", range_rows)
    rows, df = mix_rows(spark)
    got = source_mix.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {i: s for i, _, s in rows if i is not None}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = brute_targets(sizes, order)
    assert any(want[s] == 3 * sizes[s] for s in order if sizes[s]) and len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else "a"
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-9 or s == "ü"
    # "ü" holds a document larger than its target: all others three times is the nearest sum
    assert taken["ü"] == 3 * (sizes["ü"] - 20_000) < want["ü"] < 10_000
    again = source_mix.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert source_mix.mix(df.limit(0)).count() == 0
    none = source_mix.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert sorted(tuple(r) for r in none) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_fit_comes_as_near_as_any_choice_of_the_rest():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.choice(np.arange(1, 30), rng.integers(1, 5), replace=False)
        counts = rng.integers(1, 4, len(sizes))
        budget = float(rng.uniform(0, (sizes * counts).sum()))
        taken = source_mix.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        got = abs(int((sizes * taken).sum()) - budget)
        sums = {0}
        base = np.floor(counts * min(1.0, budget / (sizes * counts).sum())).astype(int)
        for s, c, b in zip(sizes.tolist(), counts.tolist(), base.tolist(), strict=True):  # what is left after the even share
            sums = {x + s * k for x in sums for k in range(b, c + 1)}
        if budget - (sizes * base).sum() <= 2 * sizes.max():
            assert abs(got - min(abs(x - budget) for x in sums)) < 1e-9
            assert int((sizes * taken).sum()) == min(sums, key=lambda x: (abs(x - budget), x))
        assert got <= sizes.max()
