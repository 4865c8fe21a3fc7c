"""Journals of a recorder loaded as trace tables."""

from __future__ import annotations

import json

from spanloom.plans.load import TraceStore
from spanloom.plans.trace import AgentTrace

EPOCH = 1_790_000_000_000_000_000


def row(ms, event, phase, id_, **more):
    return (EPOCH + ms * 1_000_000, {"event": event, "phase": phase, "id": id_, "session_id": "s", **more})


def usage(i, o):
    return {"model": "m", "input_tokens": i, "output_tokens": o, "cache_read_input_tokens": 50, "cache_creation_input_tokens": 2}


ROWS = [
    row(0, "session", "begin", "s", model="m", provider="p"),
    row(10, "prompt", "begin", "p1", prompt="Check these numbers"),
    row(20, "response", "begin", "p1:0", turn_id="p1", model="m"),
    row(100, "response", "end", "p1:0", usage=usage(5, 10), first_content_ms=5),
    row(110, "tool", "begin", "bash", tool="Bash"),
    row(330, "execution", "end", "bash", duration_ms=20, is_error=True),
    row(350, "tool", "end", "bash", is_error=True),
    row(110, "tool", "begin", "launch", tool="Agent"),
    row(150, "agent", "begin", "worker", agent_id="worker", call_id="launch", model="m", role="auditor", prompt="Verify"),
    row(160, "response", "begin", "child:0", agent_id="worker", turn_id="child", model="m"),
    row(350, "response", "end", "child:0", agent_id="worker", usage=usage(4, 7)),
    row(360, "tool", "begin", "bash", agent_id="worker", tool="Read"),  # the id of another scope
    row(385, "execution", "end", "bash", agent_id="worker", duration_ms=20, is_error=False),
    row(390, "tool", "end", "bash", agent_id="worker", is_error=False),
    row(400, "prompt", "end", "child", agent_id="worker"),
    row(690, "execution", "end", "launch", duration_ms=550, is_error=False),
    row(700, "tool", "end", "launch", is_error=False),
    row(720, "tool", "begin", "bash", tool="Bash"),  # the id again
    row(805, "compaction", "begin", "c", trigger="manual"),
    row(850, "compaction", "end", "c", success=True, pre_tokens=80, post_tokens=20),
    row(900, "prompt", "end", "p1"),
    row(1000, "session", "end", "s", reason="exit", dropped=0),
]


def observed(spark, rows, recording="r", at=0):
    data = [(recording, 0, at + i, "claude.mod", str(ts), json.dumps(d)) for i, (ts, d) in enumerate(rows)]
    return spark.createDataFrame(data, "recording string, chunk long, seq long, source string, timestamp string, data string").selectExpr(
        "recording", "chunk", "seq", "source", "cast(timestamp as decimal(20,0)) as timestamp", "data"
    )


def found(store):
    t = store.tables()
    ms = f"(ts - {EPOCH}) / 1000000 as at, dur / 1000000 as took"
    slices = sorted((tuple(r) for r in t["slice"].selectExpr("attrs.kind", "name", ms.split(", ")[0], ms.split(", ")[1], "attrs.incomplete").collect()), key=str)
    counters = sorted(((r.name, (r.ts - EPOCH) // 1_000_000, r.value) for r in t["counter"].join(t["track"].selectExpr("id as track_id", "name"), "track_id").collect()), key=str)
    names = {r.id: (r.kind, r.name) for r in t["slice"].selectExpr("id", "attrs.kind", "name").collect()}
    flows = sorted((names[r.slice_out], names[r.slice_in]) for r in t["flow"].collect())
    return slices, counters, flows


def test_a_recording_becomes_a_trace(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path))
    store.load(0, observed(spark, ROWS))
    slices, counters, flows = found(store)
    tools = [s for s in slices if s[0] == "tool-execution"]
    assert tools == [
        ("tool-execution", "Agent", 140.0, 550.0, None), ("tool-execution", "Bash", 310.0, 20.0, None),
        ("tool-execution", "Bash", 720.0, 280.0, 1),  # never closed: until the end of the session
        ("tool-execution", "Read", 365.0, 20.0, None),
    ]
    assert [s for s in slices if s[0] == "prompt"] == [("prompt", "prompt", 10.0, 890.0, None), ("prompt", "prompt", 150.0, 250.0, None)]
    assert [c for c in counters if c[0] == "llm.tokens.input"] == [("llm.tokens.input", t, v) for t, v in ((0, 0.0), (100, 5.0), (1000, 0.0), (150, 0.0), (350, 4.0), (400, 0.0))]
    assert (("tool-execution", "Agent"), ("prompt-input", "prompt-input")) in flows
    assert flows.count((("prompt", "prompt"), ("assistant-message", "response"))) == 2
    trace = AgentTrace(store.tables())
    runs = {r.session: (r.harness, r.responses, r.tools) for r in trace["capture_runs"].collect()}
    assert set(runs) == {"s", "s/worker"} and runs["s"][1] == 1 and runs["s"][2] == 3
    parents = {(r.capture_id, r.parent_capture_id) for r in trace["capture_hierarchy"].collect() if r.parent_capture_id is not None}
    assert len(parents) == 1
    owned = trace["turns"].select("prompt_id", "tools").collect()
    assert len(owned) == 2


def test_batches_can_cut_operations_and_be_run_again(spark, tmp_path):
    whole, parts = TraceStore(spark, str(tmp_path / "whole")), TraceStore(spark, str(tmp_path / "parts"))
    whole.load(0, observed(spark, ROWS))
    want = found(whole)
    first, second = observed(spark, ROWS[:7]), observed(spark, ROWS[7:], at=7)
    other = observed(spark, [(ts, d | {"session_id": "o"}) for ts, d in ROWS[:4]], "other")
    parts.load(0, first.unionByName(other))
    early = found(parts)
    assert any(s[0] == "prompt" and s[4] == 1 for s in early[0])  # still open
    parts.load(1, second)
    late = found(parts)
    parts.load(1, second)
    parts.load(0, first.unionByName(other))
    parts.load(2, second.limit(3))  # delivered again in a later batch
    assert found(parts) == late
    mine = TraceStore(spark, str(tmp_path / "parts")).tables()
    marks = mine["slice"].filter("attrs.kind = 'capture'").count()
    assert marks == 3
    # an unfinished batch is not seen
    import shutil

    shutil.rmtree(tmp_path / "parts" / "commits" / "batch=2")
    assert found(parts) == late


def test_an_empty_batch_and_rows_of_others_load(spark, tmp_path):
    store = TraceStore(spark, str(tmp_path))
    store.load(0, observed(spark, []).unionByName(observed(spark, ROWS[:2]).selectExpr("recording", "chunk", "seq", "'hook' as source", "timestamp", "data")))
    t = store.tables()
    assert all(t[n].count() == 0 for n in ("slice", "track", "counter", "flow"))


def test_repeated_observations_are_dropped_once(spark, tmp_path, monkeypatch):
    from spanloom.plans import load

    build, got = load.trace_rows, []
    monkeypatch.setattr(load, "trace_rows", lambda rows: got.append(rows) or build(rows))
    store = TraceStore(spark, str(tmp_path))
    store.load(0, observed(spark, ROWS).unionByName(observed(spark, ROWS)))
    # the tables are built from a table without repeats, which they read many times
    assert "Aggregate" not in got[0]._jdf.queryExecution().executedPlan().toString()
    assert got[0].count() == len(ROWS)
