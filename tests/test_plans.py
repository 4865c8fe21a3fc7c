"""What plans hold and what they read: the work per row, and what travels to the driver."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from spanloom.operators import trees
from spanloom.operators.blocks import NO_BLOCKS
from spanloom.operators.intervals import asof_last, innermost, interval_sweep
from spanloom.operators.trees import nearest_ancestor, path_totals
from spanloom.session import configure
from spanloom.sources.binding import bind_events
from spanloom.sources.journals import flatten_otlp_logs, otel_attributes
from tests.fixtures import Fixture, rows

def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("walk", ["ancestor", "totals", "markers", "parents", "machines"])
def test_wide_walks_are_not_broadcast(spark, fixture, monkeypatch, walk):
    """What the planner is asked for, seen in the hints of the plans."""
    hinted = []
    monkeypatch.setattr(DataFrame, "hint", lambda self, name, *a, was=DataFrame.hint: hinted.append((name, tuple(self.columns))) or was(self, name, *a))
    fixture.add(1, "prompt", 0, 10)
    t = fixture.trace()
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent_id long")
    if walk == "ancestor":
        assert rows(nearest_ancestor(nodes, is_stop=F.expr("id = 1"))) == [(1, 1), (2, 1), (3, 1)]
    elif walk == "totals":
        assert rows(path_totals(nodes, {"v": F.col("id")})) == [(1, 1), (2, 2), (3, 3)]
    else:
        t[{"markers": "capture_markers", "parents": "capture_parents", "machines": "recording_summary"}[walk]]
    wanted = {
        "ancestor": ("_ptr", "_next", "_next_done"), "totals": ("_ptr", "_next", "_next_v"), "markers": ("track_id", "capture_id"),
        "parents": ("slice_out", "parent"), "machines": ("capture_id",),
    }
    assert ("merge", wanted[walk]) in hinted


def test_methods_stay_compilable(spark):
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_session_slices_are_pruned(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    events = [(i, at + dt.timedelta(seconds=i), 1 + i % 2, t, 1.5, '{"k": %d}' % i) for i, t in enumerate(["signup", "view", "click", "error", "purchase"])]
    spark.createDataFrame(events + [(9, at, 3, "view", 1.0, '{"k": 2}')], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    slices = bind_events(spark, str(tmp_path))["slice"]
    narrow = slices.filter("id < 0").select("id", "attrs.kind")
    assert "inline" not in plan(narrow) and "session-" not in plan(narrow)
    marker, config = -(10**12), -2 * 10**12
    assert rows(narrow) == sorted(
        [(marker - u, "capture") for u in (1, 2, 3)] + [(config - u, "configuration") for u in (1, 2, 3)] + [(-1, "prompt-input")]
    )


def test_identity_of_owned_slices(fixture):
    """A slice below the marker of another capture gets the identity of that one."""
    f: Fixture = fixture
    f.capture(1, label="first")
    f.capture(2, label="second")
    f.add(11, "prompt", 0, 5)
    f.add(12, "prompt", 0, 5, parent=10**6 + 2)
    f.raw(13, None, 1002, 0, 5, "prompt", "pi.x", kind="prompt")
    got = f.trace()["slices"].filter("id < 100")
    assert rows(got, "id", "capture_id", "capture", "session") == [
        (11, 1, "first", "session-1"), (12, 2, "second", "session-2"), (13, 2, "second", "session-2"),
    ]


def test_innermost_reads_written_tables(spark):
    spans = spark.createDataFrame([(1, 1, 0, 10, 1), (1, 1, 2, 6, 2), (1, 1, 4, 4, 3)], "k int, g int, s long, e long, id long")
    found = innermost(spans.withColumn("seen", F.expr("uuid()")).filter("seen is not null"), ["k"], group="g", start="s", end="e", id_col="id")
    assert "uuid" not in plan(found) and "Window" not in plan(found)
    assert [(r.edge_ts, [tuple(x) for x in r.at], [tuple(x) for x in r.after]) for r in found.orderBy("edge_ts").collect()] == [
        (0, [(1, 1)], [(1, 1)]), (2, [(2, 2)], [(2, 2)]), (4, [(3, 3)], [(2, 2)]), (6, [(1, 1)], [(1, 1)]), (10, [], []),
    ]


def test_owners_are_written_once(fixture):
    fixture.add(1, "prompt", 0, 10)
    fixture.add(2, "tool-execution", 1, 2)
    owners = fixture.trace()["turn_owners"]
    assert "Join" not in plan(owners) and rows(owners, "id", "prompt_id") == [(2, 1)]


def test_log_attributes_are_built_once(spark):
    pair = '{"key":"%s","value":{"stringValue":"%s"}}'
    record = '{"traceId":"t","timeUnixNano":"%d","attributes":%s}'
    batch = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[' + ",".join(
        [record % (0, "[" + ",".join([pair % ("event.timestamp", "1970-01-01T00:00:01.000Z"), pair % ("a", "old"), pair % ("a", "new")]) + "]"), record % (7, "null")]
    ) + "]}]}]}"
    logs = flatten_otlp_logs(spark.createDataFrame([("r", 1, batch), ("r", 2, batch)], "recording string, seq long, data string"))
    assert plan(logs).count("map_from_entries") == 1
    assert rows(logs.selectExpr("at_ns", "attrs['a'] as a", "attrs is null as none")) == [(7, None, True), (10**9, "new", False)]
    attrs = spark.range(1).select(otel_attributes(F.from_json(F.lit("[" + ",".join([pair % ("a", "1"), pair % ("b", "2"), pair % ("a", "3")]) + "]"), "array<struct<key:string,value:struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,arrayValue:struct<values:array<struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>>>>")).alias("m"))
    assert attrs.first().m == {"b": "2", "a": "3"}


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouping_by_the_keys_of_an_asof_join_needs_no_shuffle(spark):
    left = spark.createDataFrame([(1, 5, 10), (2, 5, 30), (3, None, 10)], "id long, k long, ts long")
    right = spark.createDataFrame([(7, 5, 10), (8, 5, 20), (9, None, 1)], "id long, k long, ts long")
    found = asof_last(left, right, ["k"], left_ts="ts", right_ts="ts", right_tie="id", value=F.col("id"), out="rid", blocks=NO_BLOCKS)
    assert found.columns == ["id", "k", "ts", "rid"]
    grouped = found.groupBy("id", "k").agg(F.max("rid").alias("rid"))
    assert executed(grouped).count("Exchange hashpartitioning") == 1
    assert rows(grouped) == [(1, 5, 7), (2, 5, 8), (3, None, 9)]


def test_cpu_samples_are_numbered_once(fixture):
    f: Fixture = fixture
    f.add(1, "tool-execution", 0, 4)
    f.add(2, "script", 3, 20)
    f.table("track", (-1, 1, "runtime.cpu", None, None))
    f.table("counter_track", (-1, "runtime.cpu"))
    f.table("counter", (-1, 2 * 10**6, 7.0), (-1, 6 * 10**6, 4.0), (-1, 10 * 10**6, 8.0))
    got = f.trace()["phase_cpu"]
    # the one window that is left is that of the as-of join
    assert plan(got).count("Window [") == 1
    # one phase begins before the first sample, the other ends after the last
    assert rows(got, "id", "track_id", "cpu_ns", "covered_ns") == [(1, -1, 2000, 2 * 10**6), (2, -1, 11000, 7 * 10**6)]


def test_sweep_ships_whole_intervals(spark):
    spans = spark.createDataFrame([(1, 0, 10, 1), (1, 4, 6, 1), (2, 0, 3, 1)], "k long, ts long, end_ts long, one int")
    swept = interval_sweep(spans, ["k"], ["one"], blocks=NO_BLOCKS)
    found = plan(swept)
    # edges are made below no exchange, so half as many rows travel
    assert 0 <= found.index("Generate inline") < found.index("RepartitionByExpression")
    assert rows(swept.filter("dur is not null")) == [(1, 0, 4, 1), (1, 4, 2, 2), (1, 6, 4, 1), (2, 0, 3, 1)]


@pytest.mark.parametrize("walk", ["ancestor", "totals"])
def test_walks_do_not_stack_rounds_in_one_plan(spark, monkeypatch, walk):
    cuts = []
    monkeypatch.setattr(trees, "cut_lineage", lambda df, was=trees.cut_lineage: cuts.append(plan(df).count("Join ")) or was(df))
    nodes = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 10)], "id long, parent_id long")
    if walk == "ancestor":
        assert rows(nearest_ancestor(nodes, is_stop=F.expr("id = 1"))) == [(i, 1) for i in range(1, 10)]
    else:
        assert rows(path_totals(nodes, {"v": F.col("id")})) == [(i, i) for i in range(1, 10)]
    assert max(cuts) <= 2


def test_walks_of_repeated_ids_take_three_rounds(spark):
    """A row that names itself as parent beside one with a way out yields 1, 2 and 4 copies in three rounds; cutting every round changes none of it."""
    nodes = spark.createDataFrame([(1, None), (2, 1), (2, 2)], "id long, parent_id long")
    assert rows(nearest_ancestor(nodes, is_stop=F.expr("id = 1"))) == [(1, 1)] + [(2, 1)] * 7
