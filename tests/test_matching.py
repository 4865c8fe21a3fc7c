"""Order-dependent matches and innermost intervals against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators.blocks import NO_BLOCKS, plan_blocks
from spanloom.operators.intervals import innermost, islands
from spanloom.operators.matching import brackets, first_unused, lone_unused
from spanloom.plans import ingest


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


@pytest.fixture(params=[None, 7])
def cut(request, monkeypatch):
    """Once with whole keys, once with every key cut into small blocks."""
    if request.param:
        import spanloom.operators.blocks as b

        plan = plan_blocks

        def small(df, keys, order, **how):
            return plan(df, keys, order, **(how | {"block_rows": request.param, "rows": None}))

        monkeypatch.setattr(b, "plan_blocks", small)
        monkeypatch.setattr("spanloom.operators.intervals.plan_blocks", small)
    return request.param


def lifo(events):
    open_, out = [], []
    for ts, phase in sorted(events):
        if phase == "begin":
            open_.append(ts)
        elif open_:
            out.append((open_.pop(), ts))
    return out + [(ts, None) for ts in open_]


def test_brackets_are_last_in_first_out(spark, cut):
    rng = random.Random(1)
    data = {k: list({(rng.randint(0, 60), rng.choice(["begin", "end"])) for _ in range(n)}) for k, n in (("a", 90), ("b", 1), ("c", 20), (None, 6))}
    df = spark.createDataFrame([(k, t, p) for k, v in data.items() if k for t, p in v], "k string, ts long, phase string")
    got = rows(brackets(df, ["k"], ["ts", "phase"], is_begin="phase = 'begin'"), "k", "begin.ts", "end.ts")
    assert got == sorted(((k, *p) for k, v in data.items() if k for p in lifo(v)), key=str)
    assert brackets(df.limit(0), ["k"], ["ts", "phase"], is_begin="phase = 'begin'").count() == 0


def test_a_reused_id_is_two_operations(spark):
    steps = [("s", "tool", "1", p, t) for p, t in (("begin", 1), ("end", 5), ("begin", 10), ("end", 12), ("end", 12))]
    steps += [("s", "prompt", "1", p, t) for p, t in (("begin", 1), ("begin", 3), ("end", 5), ("end", 12), ("end", 20))] + [("t", "tool", "1", "begin", 4)]
    e = spark.createDataFrame(steps, "scope string, event string, id string, phase string, ts long")
    ends = spark.createDataFrame([("t", 9)], "scope string, end_ts long")
    assert rows(ingest.pair_begin_end(e, ends), "scope", "event", "start_ts", "end_ts", "incomplete") == [
        ("s", "prompt", 1, 12, False), ("s", "prompt", 3, 5, False), ("s", "tool", 1, 5, False), ("s", "tool", 10, 12, False), ("t", "tool", 4, 9, True)
    ]


def greedy_first(turns, logs):
    used, out = set(), []
    for i, s, a, b in sorted(turns, key=lambda t: (t[1], t[2], t[0])):
        hit = next((j for j, k, t in sorted(logs, key=lambda x: (x[2], x[0])) if k == s and j not in used and b is not None and a - 1_000_000_000 <= t <= b), None)
        if hit is not None:
            used.add(hit)
            out.append((i, hit))
    return sorted(out, key=str)


def test_turns_take_the_first_log_nobody_took(spark, cut):
    rng = random.Random(2)
    sec = 1_000_000_000
    turns, logs = [], []
    for i in range(160):
        start = rng.randint(0, 100) * sec // 2
        turns.append((i, rng.choice("aab"), start, None if i % 17 == 0 else start + rng.choice([-1, 0, 1, 5, 40]) * sec))
    logs = [(1000 + i, rng.choice("aabc"), rng.randint(-3, 110) * sec // 2) for i in range(120)]
    t = spark.createDataFrame(turns, "id long, session string, start_ts long, end_ts long")
    g = spark.createDataFrame(logs, "id long, session string, ts long")
    assert rows(first_unused(t, g, "session", low="start_ts - 1000000000", high="end_ts", order=["start_ts"])) == greedy_first(turns, logs)
    got = ingest.match_prompt_log(t, g).collect()
    assert len([r for r in got if r.id is not None]) == 160 and {r.log_id for r in got if r.log_id} == {i for i, _, _ in logs}
    assert all(r.incomplete == (r.id is None) for r in got)
    assert ingest.match_prompt_log(t.limit(0), g).count() == 120 and ingest.match_prompt_log(t, g.limit(0)).count() == 160


def greedy_lone(completions, streams):
    ms, used, out = 1_000_000, set(), []
    for i, s, at in sorted(completions, key=lambda c: (c[1], c[2], c[0])):
        near = [j for j, k, a, b in streams if k == s and j not in used and a <= at + ms and at - ms <= b <= at + 5 * ms]
        if len(near) == 1:
            used.add(near[0])
            out.append((i, near[0]))
    return sorted(out, key=str)


def test_completions_take_the_one_stream_that_is_left(spark, cut):
    rng = random.Random(3)
    ms = 1_000_000
    completions = [(i, rng.choice("aab"), rng.randint(0, 400) * ms // 2) for i in range(150)]
    streams = [(1000 + i, rng.choice("aabc"), end - rng.choice([-4, 0, 3, 80]) * ms, end) for i, end in ((i, rng.randint(0, 400) * ms // 2) for i in range(150))]
    c = spark.createDataFrame(completions, "id long, session string, ts long")
    s = spark.createDataFrame(streams, "id long, session string, start_ts long, end_ts long")
    want = greedy_lone(completions, streams)
    assert rows(lone_unused(c, s, "session", before=ms, after=5 * ms, slack=ms), "id", "offer_id") == want
    # a second completion is decided by what the first took
    two = spark.createDataFrame([(1, "a", 10 * ms), (2, "a", 12 * ms)], c.schema)
    ends = spark.createDataFrame([(7, "a", 0, 11 * ms), (8, "a", 11 * ms + 1, 16 * ms)], s.schema)
    assert rows(ingest.match_completion_to_stream(two, ends), "id", "stream_id", "timing") == [(1, 7, "native-stream"), (2, 8, "native-stream")]
    assert rows(ingest.match_completion_to_stream(two, ends.limit(0)), "id", "stream_id", "incomplete") == [(1, None, True), (2, None, True)]


def owners(members, x):
    inside = [p for p in members if p[1] <= x < p[2] or p[1] == p[2] == x]
    if not inside:
        return set()
    s, e = max(p[1] for p in inside), min(p[2] for p in inside)
    return {p[0] for p in inside if p[1] == s and p[2] == e}


def chosen(choice):
    ids = {c[k] for c in choice for k in ("low", "high")}
    return next(iter(ids)) if len(ids) == 1 else None


def test_innermost_equals_brute_force(spark, cut):
    rng = random.Random(5)
    members = []
    for i in range(140):
        s = rng.randint(0, 60)
        members.append((i, rng.choice("aaab"), s, s + rng.choice([0, 0, 1, 2, 5, 30])))
    df = spark.createDataFrame(members, "id long, k string, s long, e long")
    groups = islands(df, ["k"], start="s", end="e", tie="id")
    got = {(r.k, r.edge_ts): r for r in innermost(groups, ["k"], group="cluster_id", start="s", end="e", id_col="id").collect()}
    assert set(got) == {(k, x) for _, k, s, e in members for x in (s, e)}
    cluster = {r.id: (r.k, r.cluster_id) for r in groups.collect()}
    for (k, x), r in got.items():
        # candidates come from each group on its own: two groups that meet leave it open
        parts = {}
        for p in members:
            if p[1] == k:
                parts.setdefault(cluster[p[0]], []).append((p[0], p[2], p[3]))
        for where, mine in ((x, r.at), (x + 0.5, r.after)):
            want = set().union(*(owners(m, where) for m in parts.values()))
            assert chosen(mine) == (next(iter(want)) if len(want) == 1 else None)


def test_many_nested_intervals_stay_n_log_n(spark):
    n = 20_000
    nested = spark.range(n).selectExpr("id", "'a' as k", "id as s", f"{2 * n}L - id as e", "1L as cluster_id")
    got = innermost(nested, ["k"], group="cluster_id", start="s", end="e", id_col="id", blocks=NO_BLOCKS)
    bad = got.selectExpr("edge_ts", "get(after, 0).low as low").filter(f"low is distinct from case when edge_ts < {n} then edge_ts when edge_ts < {2 * n} then {2 * n} - edge_ts - 1 end")
    assert bad.count() == 0 and got.count() == 2 * n
