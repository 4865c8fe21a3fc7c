from __future__ import annotations

import pytest

from spanloom.plans import context, sessions, tools, turns
from spanloom.sources.tables import attach_attributes, pivot_attributes, read_trace_tables, write_trace_tables
from tests.fixtures import MS, Fixture, rows


def test_turn_groups_cycles_with_unioned_overlap(fixture):
    f = fixture
    f.add(1, "prompt", 0, 20, text="User request")
    f.add(2, "assistant-message", 1, 5, input_tokens=10, output_tokens=5, provider="p", model="m")
    f.add(3, "provider-request", 0.5, 1)
    f.add(4, "tool-execution", 6, 2)
    f.add(5, "assistant-message", 8, 3, input_tokens=10, output_tokens=5, provider="p", model=" ")
    f.add(6, "tool-execution", 10, 5)
    f.add(7, "provider-request", 9, 1)
    f.add(8, "turn", 0, 6)
    f.table("flow", (3, 2))
    t = f.trace()
    row = t["turns_with_prompts"].first()
    assert (row.events, row.model_calls, row.tools, row.unmatched_requests, row.input_tokens, row.output_tokens) == (5, 2, 2, 1, 20, 10)
    assert (row.models_only_ns, row.tools_only_ns, row.overlap_ns, row.unattributed_ns) == (7 * MS, 6 * MS, MS, 6 * MS)
    assert row.display_end_ts == 20 * MS and row.prompt_text == "User request" and row.turn_number == 1
    assert row.model_identities == '[{"provider":"p","model":null},{"provider":"p","model":"m"}]'
    assert [r.id for r in turns.turn_waterfall(t, 1, 500).collect()] == [2, 4, 5, 7, 6]
    assert [r.id for r in turns.turn_waterfall(t, 1, 2).collect()] == [2, 4]
    assert turns.turn_waterfall(t, 1, 2).first().total_events == 5
    assert turns.turns_page(t, 0, 1).first().total_turns == 1


def owners(t):
    return rows(t["turn_events"], "id", "prompt_id")


@pytest.mark.parametrize("block_rows", [1_000_000, 3])
def test_nested_owner_is_unique_and_overlap_is_ambiguous(fixture, block_rows):
    f = fixture
    for args in [(1, "prompt", 0, 20), (2, "prompt", 5, 5), (3, "tool-execution", 6, 1), (4, "prompt", 30, 20), (5, "prompt", 40, 20), (6, "tool-execution", 45, 1)]:
        f.add(*args)
    f.add(7, "tool-execution", 46, 1, parent=4)
    f.add(8, "prompt", 30, 20, capture=2)
    f.add(9, "tool-execution", 45, 1, capture=2)
    t = f.trace(block_rows=block_rows)
    assert owners(t) == [(3, 2), (6, None), (7, 4), (9, 8)]
    assert rows(t["turn_unassigned_totals"]) == [(1, 0, 1)]


def test_native_identity_beats_containment_and_reused_one_falls_back(spark):
    f = Fixture(spark)
    f.add(1, "prompt", 0, 20, turn_id="first")
    f.add(2, "prompt", 10, 20, turn_id="second")
    f.add(3, "tool-execution", 15, 1, turn_id="first")
    assert owners(f.trace()) == [(3, 1)]
    f = Fixture(spark)
    f.add(1, "prompt", 0, 10, turn_id="reused")
    f.add(2, "prompt", 20, 10, turn_id="reused")
    f.add(3, "assistant-message", 21, 1, parent=2, turn_id="reused")
    assert owners(f.trace()) == [(3, 2)]


def test_flows_resolve_and_keep_captures_apart(fixture):
    f = fixture
    f.add(1, "prompt", 0, 20)
    f.add(2, "prompt", 10, 20)
    f.add(3, "assistant-message", 15, 1)
    f.add(4, "tool-execution", 16, 1)
    f.add(5, "assistant-message", 15, 1, capture=2)
    f.table("flow", (1, 3), (3, 4), (1, 5))
    assert owners(f.trace()) == [(3, 1), (4, 1), (5, None)]


def test_ancestry_stops_at_prompts_and_captures(fixture):
    f = fixture
    f.add(1, "prompt", 0, 100)
    for i in range(10, 110):
        f.raw(i, 1 if i == 10 else i - 1, 1001, 0, 0, "native", "other.category")
    f.add(2, "prompt", 10, 50, parent=109)
    f.add(3, "assistant-message", 20, 1, parent=2)
    f.add(4, "tool-execution", 20, 1, parent=109)
    f.capture(2)
    f.raw(200, 1, 1001, 0, 0, "tracing", "pi.metadata", kind="capture", capture_id=format(4098, "x"), session_id="session-2")
    f.raw(5, 200, 1001, 20 * MS, MS, "x", "pi.tools", kind="tool-execution")
    assert owners(f.trace()) == [(3, 2), (4, 1), (5, None)]


def test_request_ids_match_half_open(fixture):
    f = fixture
    f.add(1, "prompt", 0, 30)
    f.add(2, "provider-request", 0, 10, request_id="reused")
    f.add(3, "assistant-message", 10, 5, request_id="reused")
    f.add(4, "provider-request", 11, 1, request_id="reused")
    assert [r[0] for r in owners(f.trace())] == [2, 3]


@pytest.mark.parametrize("explicit", [False, True])
def test_ambiguous_requests_stay_visible(fixture, explicit):
    f = fixture
    f.add(1, "prompt", 0, 30)
    f.add(2, "provider-request", 0, 20, request_id="reused")
    f.add(3, "provider-request", 5, 10, request_id="reused")
    f.add(4, "assistant-message", 7, 5, request_id="reused")
    if explicit:
        f.table("flow", (3, 4))
    t = f.trace()
    assert [r[0] for r in owners(t)] == ([2, 4] if explicit else [2, 3, 4])
    assert rows(t["turns"], "unmatched_requests") == [(1 if explicit else 2,)]


def test_large_prompt_groups_give_no_owner_by_containment(fixture):
    f = fixture
    for i in range(65):
        f.add(1 + i, "prompt", i, 100)
    f.add(500, "tool-execution", 64.5, 1)
    assert owners(f.trace()) == [(500, None)]


def test_the_innermost_of_many_nested_prompts_owns(fixture):
    f = fixture
    for i in range(65):
        f.add(1 + i, "prompt", i, 200 - 2 * i)
    f.add(500, "tool-execution", 80, 1)
    f.add(501, "tool-execution", 10.5, 1)
    assert owners(f.trace()) == [(500, 65), (501, 11)]


def test_incomplete_prompt_shows_observed_work_only(fixture):
    f = fixture
    f.add(1, "prompt", 0, -1)
    f.add(2, "tool-execution", 0.25, 0.75)
    f.add(3, "other", 0, 50)
    assert rows(f.trace()["turns"], "display_end_ts", "incomplete") == [(MS, True)]


def two_captures(f):
    for c in (1, 2):
        f.capture(c, session="reused")
    base = 100_000_000
    f.add(1, "prompt", 0, 20)
    p = dict(provider="provider", model="model")
    f.add(2, "assistant-message", 1, 5, input_tokens=10, output_tokens=5, first_content_ns=MS, **p)
    f.add(3, "tool-execution", 6, 4, name="read")
    f.add(4, "tool-execution", 8, 7, name="read")
    f.add(5, "assistant-message", 9, 3, input_tokens=10, output_tokens=0, **p)
    f.add(6, "assistant-message", 18, 2, incomplete=True, input_tokens=10, output_tokens=4, first_content_ns=MS, **p)
    f.add(7, "assistant-message", 17, 0, input_tokens=10, output_tokens=7, **p)
    f.add(8, "tool-execution", 18, -1, name="unfinished")
    f.add(9, "turn", 0, 5)
    f.add(10, "assistant-message", base + 0.01, 0, capture=2, **p)
    return f.trace()


def test_occupancy_and_cohorts(fixture):
    t = two_captures(fixture)
    occupancy = {r.capture_id: r for r in t["capture_occupancy"].collect()}
    one = occupancy[1]
    assert len(occupancy) == 2 and one.observed_extent_ms == 20
    assert (one.model_only_ms, one.tool_only_ms, one.overlap_ms, one.unattributed_ms) == (5, 6, 3, 6)
    assert (one.parallel_tool_ms, one.peak_tools) == (2, 2)
    cohorts = {r.capture_id: r for r in t["model_cohorts"].collect()}
    a, b = cohorts[1], cohorts[2]
    assert (a.duration_samples, a.median_ms, a.p95_ms, a.first_content_samples) == (2, 4, 5, 1)
    assert (a.output_samples, a.throughput_samples, a.output_tokens_per_s) == (4, 2, 625)
    assert (b.duration_samples, b.throughput_samples, b.output_tokens_per_s) == (0, 0, None)
    # unknown usage stays unknown
    assert b.reported_output_tokens is None


def test_nested_markers_own_their_slices(fixture):
    f = fixture
    for c in (100, 200, 300):
        f.table("track", (c, None, "spanloom.capture", None, c))
    f.table("track", (1, None, "shared", None, None), (2, None, "lonely", None, None), (3, None, "third", None, None))
    for id, parent, category, track, c in [
        (1, None, "pi.metadata", 1, 100), (2, 1, "pi.agent", 1, None), (3, 1, "pi.metadata", 1, 200), (4, 3, "pi.agent", 1, None),
        (5, 1, "pi.agent", 1, None), (6, 4, "unrelated.category", 1, None), (7, 6, "pi.tools", 1, None), (8, None, "pi.agent", 2, None),
        (9, None, "pi.metadata", 3, 300), (10, 9, "pi.agent", 3, None),
    ]:
        f.raw(id, parent, track, 0, 0, "tracing" if c else "x", category, **({"capture_id": format(c, "x")} if c else {}))
    t = f.trace()
    assert rows(t["slice_capture"]) == [(1, 100), (2, 100), (3, 200), (4, 200), (5, 100), (7, 200), (9, 300), (10, 300)]
    # without a marker or process a slice falls back to its own track
    assert rows(t["slices"].filter("id = 8"), "capture_id", "session", "capture") == [(-3, "process unknown", "Legacy capture")]


def test_legacy_kinds(fixture):
    f = fixture
    f.capture(1)
    cases = [("prompt", "pi.agent,pi.prompt-data", "prompt"), ("prompt", "pi.agent", "prompt"), ("turn", "pi.agent", "turn"), ("prompt-input", "pi.agent", "other"), ("prompt", "pi.agent-other", "other")]
    for i, (name, category, _) in enumerate(cases):
        f.raw(i, None, 1001, 0, 0, name, category)
    assert [r[1] for r in rows(f.trace()["slices"].filter("id < 100"), "id", "kind")] == [c[2] for c in cases]


def test_hierarchy_cycles_and_ambiguity_stay_roots(fixture):
    f = fixture
    f.capture(1, session="root")
    f.capture(2, session="kid", parent_session="root")
    f.capture(3, session="a", parent_session="b")
    f.capture(4, session="b", parent_session="a")
    f.capture(5, session="twin")
    f.capture(6, session="twin")
    f.capture(7, session="lost", parent_session="twin")
    f.capture(8, session="grandkid", parent_session="kid")
    t = f.trace()
    h = {r.capture_id: (r.root_capture_id, r.parent_capture_id) for r in t["capture_hierarchy"].collect()}
    assert h == {1: (1, None), 2: (1, 1), 3: (3, 4), 4: (4, 3), 5: (5, None), 6: (6, None), 7: (7, None), 8: (1, 2)}
    below = sessions.capture_descendants(t, t["capture_hierarchy"].filter("capture_id = 1"))
    assert rows(below) == [(1, 1, 0), (1, 2, 1), (1, 8, 2)]
    # captures never merge over an equal session
    assert t["capture_runs"].filter("session = 'twin'").count() == 2


def test_idle_bins_are_zero_and_unmeasured_ones_null(fixture):
    f = fixture
    f.add(1, "tool-execution", 0, 10)
    f.add(2, "other", 0, 480)
    f.add(3, "other", 0, 48, capture=2)
    bins = rows(f.trace()["capture_activity_bins"], "capture_id", "bin", "busy_fraction")
    assert bins[0] == (1, 0, 1.0) and all(b == 0.0 for _, _, b in bins[1:48])
    assert all(b is None for _, _, b in bins[48:])


def test_context_changes_point_at_their_tool(fixture):
    f = fixture
    f.add(1, "tool-execution", 0, 1, call_id="read-1", name="read")
    item = dict(id="x", category="results", change="added", tokens=40, delta_tokens=40, chars=160, source_id="read-1", source_kind="tool", label="secret")
    for i, (est, base, changes) in enumerate([(3, 1, []), (43, 0, [item]), (3, 0, [dict(item, change="removed", delta_tokens=-40, source_id="")])]):
        f.add(10 + i, "assistant-message", 2 + i, 0, context=dict(version=1, stage="request", basis="chars/4", baseline=base, estimated_tokens=est, reported_tokens=20 * (i + 1), categories={"results": est}, changes=changes))
    t = f.trace()
    assert rows(t["context_changes"], "delta_tokens", "tool", "event_id", "previous_estimated_tokens") == [(-40, None, 12, 43), (40, "read", 1, 3)]
    assert "label" not in t["context_changes"].columns
    assert rows(t["context_summary"], "snapshots", "retained_changes", "estimated_tokens") == [(3, 2, 3)]
    assert context.top_context_changes(t, 1).count() == 1


def test_runtime_gauges_ignore_closing_zero(fixture):
    f = fixture
    f.capture(1)
    f.table("track", (50, 1, "runtime.rss", None, None), (51, 1, "CPU time (interval)", None, None))
    f.table("counter_track", (50, "runtime.rss"), (51, "CPU time (interval)"))
    f.table("counter", (50, 1, 100.0), (50, 2, 200.0), (50, 3, 0.0), (51, 1, 0.0), (51, 2, 1000.0), (51, 3, 2000.0))
    t = f.trace()
    assert rows(t["runtime_summary"], "metric", "minimum", "maximum", "sampled_cpu_us") == [
        ("CPU time (interval)", 0.0, 2000.0, 3000.0), ("Resident memory", 100.0, 200.0, None)
    ]
    assert rows(t["cpu_sample_intervals"], "start_ts", "end_ts", "cpu_us") == [(1, 2, 1000.0), (2, 3, 2000.0)]


def test_script_cycles_end_where_they_began(fixture):
    f = fixture
    f.add(1, "script", 0, 9, call_id="a", parent_call_id="b")
    f.add(2, "tool-execution", 1, 1, call_id="b", parent_call_id="a")
    f.add(3, "tool-execution", 2, 1, call_id="c", parent_call_id="c")
    assert rows(f.trace()["script_children"], "script_id", "id", "depth") == [(1, 2, 1)]


def test_deep_scripts_are_followed_to_their_end(fixture):
    f = fixture
    for i in range(40):
        f.add(1 + i, "script" if i == 0 else "tool-execution", i, 1, call_id=f"c{i}", parent_call_id=f"c{i - 1}" if i else None)
    assert f.trace()["script_children"].agg({"depth": "max"}).first()[0] == 39


def test_attributes_pivot_prefers_current_keys(spark):
    args = [
        (1, "debug.model", "debug.model", "new", None, "new"), (1, "debug.acme_llm_model", "debug.acme_llm_model", "old", None, "old"),
        (1, "debug.acme_usage_input", "debug.acme_usage_input", None, 7, "7"), (1, "debug.args", "debug.args", "x", None, "x"),
        (1, "debug.args.path", "debug.args.path", "f", None, "f"), (1, "debug.args[0]", "debug.args", "e", None, "e"),
        (1, "debug.session_labels[0]", "debug.session_labels", "plan", None, "plan"), (1, "debug.context.version", "debug.context.version", None, 1, "1"),
        (1, "debug.context.categories.prompts", "debug.context.categories.prompts", None, 5, "5"),
        (1, "debug.context.changes[0].id", "debug.context.changes.id", "i", None, "i"),
        (1, "debug.context.changes[0].tokens", "debug.context.changes.tokens", None, 3, "3"),
    ]
    df = spark.createDataFrame(args, "arg_set_id long, key string, flat_key string, string_value string, int_value long, display_value string")
    a = pivot_attributes(df, legacy_prefix="acme").first().attrs
    assert (a.model, a.input_tokens, a.session_labels, a.args) == ("new", 7, ["plan"], {"value": "x", "path": "f", "[0]": "e"})
    assert a.context.categories == {"prompts": 5} and a.context.changes[0].tokens == 3
    assert pivot_attributes(df).first().attrs.input_tokens is None
    raw = spark.createDataFrame([(9, None, 1, 0, 0, "n", "pi.x", 1)], "id long, parent_id long, track_id long, ts long, dur long, name string, category string, arg_set_id long")
    assert attach_attributes(raw, df).first().attrs.model == "new"


def test_tables_round_trip(fixture, tmp_path):
    t = two_captures(fixture)
    write_trace_tables(t.tables, str(tmp_path / "trace"))
    again = read_trace_tables(t.spark, str(tmp_path / "trace"))
    from spanloom.plans.trace import AgentTrace

    names = AgentTrace(again).register("t_")
    assert "turns" in names and t.spark.sql("select count(*) from t_turns").first()[0] == 1


def test_sums_of_durations_beyond_a_long(fixture):
    f = fixture
    long_ms = 4 * 10**12  # 4e18 ns, so three of them are more than a long holds
    for i in range(3):
        f.add(10 + i, "assistant-message", i, long_ms, provider="p", model="m", output_tokens=10, first_content_ns=4 * 10**18)
        f.add(20 + i, "tool-execution", i, long_ms, name="bash", is_error=0)
    t = f.trace()
    row = t["models_overview"].first()
    assert (row.responses, row.duration_ms, row.first_content_ms) == (3, long_ms, long_ms)
    assert t["tools_overview"].first().work_ms == 3 * long_ms
    assert t["tool_summary"].filter("kind = 'tool-execution'").first().summed_work_ms == 3 * long_ms
    rate = pytest.approx(30 / (3 * long_ms / 1000))
    assert t["recording_headline"].first().output_tokens_per_s == rate
    assert t["model_cohorts"].first().output_tokens_per_s == rate and t["model_cohorts"].first().mean_ms == long_ms
    assert t["session_details"].first().tokens_per_s == rate


def test_joins_on_all_operations_are_never_broadcast(fixture):
    f = fixture
    f.add(1, "prompt", 0, 20)
    f.add(2, "script", 1, 5, call_id="a")
    f.add(3, "tool-execution", 2, 1, parent_call_id="a", call_id="b")
    f.table("flow", (2, 3))
    t = f.trace()
    # the planner takes tables of any size for small ones if only a few of many columns are read
    plan = t["flow_pairs"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 2
    plan = t["turn_operations"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 9
    assert rows(t["flow_pairs"], "from_kind", "to_kind", "flows") == [("script", "tool-execution", 1)]
    assert [(r.id, r.depth) for r in turns.turn_waterfall(t, 1).collect()] == [(2, 0), (3, 1)]


def test_events_are_numbered_and_grouped_once(spark, tmp_path):
    from spanloom.sources.binding import bind_events

    spark.range(20).selectExpr(
        "id as event_id", "timestampadd(SECOND, cast(id as int), timestamp_ntz'2024-01-01 00:00:00') as ts", "id % 3 as user_id",
        "element_at(array('signup', 'view', 'click', 'error', 'purchase'), cast(id % 5 + 1 as int)) as event_type", "id * 0.5D as value",
        "concat('{\"k\": ', id, '}') as props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    tables = bind_events(spark, str(tmp_path))
    for name in ("slice", "track", "counter", "flow"):
        plan = tables[name]._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "events.parquet" not in plan
    assert tables["slice"].filter("id >= 0").count() == 20
