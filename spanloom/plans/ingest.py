"""From recorded events to intervals, edges and counters.

Each function is one stage of an ingest job over all recordings.  Frames carry
their key columns as named in each docstring; times are LONG nanoseconds.
Matches that a recorder makes one by one in arrival order give the same results
here: see :mod:`spanloom.operators.matching`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.operators.blocks import Blocks, Run, running
from spanloom.operators.intervals import asof_last
from spanloom.operators.matching import brackets, first_unused, lone_unused
from spanloom.operators.trees import descendant_totals, expand_edges, nearest_ancestor
from spanloom.session import cut_lineage

MS = 1_000_000


# ----------------------------------------------------------------- pairing
def pair_begin_end(events: DataFrame, session_ends: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Operations from begin and end rows of ``(scope, event, id)``, last in first out.

    ``events``: ``scope, event, id, phase, ts``; ``session_ends``: ``scope,
    end_ts``.  An id may be used again: 1-5 and 10-12 are two operations, and so
    are 1-12 and 3-5.  Rows delivered twice count once; at equal times begins come
    first; an end without a begin is dropped.  An operation without an end closes
    with its session, else with the scope's last event, and is incomplete.
    """
    steps = events.select("scope", "event", "id", "phase", "ts").filter("phase in ('begin', 'end')").distinct()
    ops = brackets(steps, ["scope", "event", "id"], ["ts", "phase"], is_begin="phase = 'begin'", blocks=blocks)
    last = events.groupBy("scope").agg(F.max("ts").alias("last_ts"))
    closed = session_ends.groupBy("scope").agg(F.max("end_ts").alias("session_end"))
    return (
        ops.join(last.join(closed, "scope", "left"), "scope")
        .selectExpr(
            "scope", "event", "id", "begin.ts as start_ts",
            "greatest(begin.ts, coalesce(end.ts, session_end, last_ts)) as end_ts", "end is null as incomplete",
        )
    )


def pair_hook_dispatch(hooks: DataFrame, native_calls: DataFrame, capture_end: Column) -> DataFrame:
    """Tool dispatches and compactions from hooks: ``session, hook, call_id, ts,
    exit_code, is_error, tool``.  Calls with a native result are left out; an
    exit code decides failure before the recorded flag.

    Returns ``session, kind, call_id, name, start_ts, end_ts, incomplete,
    exit_code, is_error``.
    """
    tools = (
        hooks.filter("hook in ('PreToolUse', 'PostToolUse')")
        .join(native_calls.select("session", "call_id").distinct(), ["session", "call_id"], "left_anti")
        .groupBy("session", "call_id")
        .agg(
            F.expr("min(ts) filter (where hook = 'PreToolUse') as start_ts"),
            F.expr("max(ts) filter (where hook = 'PostToolUse') as done_ts"),
            F.expr("max_by(tool, ts) filter (where hook = 'PreToolUse') as name"),
            F.expr("max_by(exit_code, ts) filter (where hook = 'PostToolUse') as exit_code"),
            F.expr("max_by(is_error, ts) filter (where hook = 'PostToolUse') as flagged"),
        )
        .filter("start_ts is not null")
        .selectExpr(
            "session", "'tool-execution' as kind", "call_id", "if(name = 'Bash', 'bash', name) as name", "start_ts", "done_ts",
            "exit_code", "coalesce(exit_code != 0, flagged) as is_error",
        )
    )
    marks = hooks.filter("hook in ('PreCompact', 'PostCompact')").select("session", "hook", "ts")
    paired = running(marks, ["session"], ["ts", "hook"], {"next_hook": Run("lead", F.col("hook")), "next_ts": Run("lead", F.col("ts"))})
    compactions = paired.filter("hook = 'PreCompact'").selectExpr(
        "session", "'compaction' as kind", "cast(null as string) as call_id", "'compaction' as name", "ts as start_ts",
        "if(next_hook = 'PostCompact', next_ts, null) as done_ts", "cast(null as bigint) as exit_code",
        "cast(null as boolean) as is_error",
    )
    return tools.unionByName(compactions).select(
        "session", "kind", "call_id", "name", "start_ts", F.coalesce("done_ts", capture_end).alias("end_ts"),
        F.col("done_ts").isNull().alias("incomplete"), "exit_code", "is_error",
    )


def place_reported_duration(rows: DataFrame) -> DataFrame:
    """Start of operations that report how long they took: ``start_ts, end_ts``
    (observed dispatch) and ``reported_ns``.  A report is used when it fits the
    dispatch within a millisecond, else the dispatch stands, incomplete."""
    fits = "(reported_ns >= 0 and reported_ns <= end_ts - start_ts + 1000000)"
    return rows.selectExpr(
        *[c for c in rows.columns if c not in ("start_ts", "reported_ns")],
        f"if(coalesce({fits}, false), end_ts - reported_ns, start_ts) as start_ts",
        f"not coalesce({fits}, false) as incomplete",
    )


def fallback_unmatched_tools(hooks: DataFrame, spans: DataFrame, last_ts: DataFrame) -> DataFrame:
    """Tools that only hooks saw: ``session, call_id, hook, ts, tool``.  They
    end at their later Post hook, else with the session, and are incomplete."""
    unseen = hooks.join(spans.select("session", "call_id").distinct(), ["session", "call_id"], "left_anti")
    seen = unseen.groupBy("session", "call_id").agg(
        F.expr("max_by(tool, ts) filter (where hook = 'PreToolUse') as name"),
        F.expr("max(ts) filter (where hook = 'PreToolUse') as start_ts"),
        F.expr("max(ts) filter (where hook like 'PostToolUse%') as post_ts"),
    ).filter("start_ts is not null")
    return seen.join(last_ts, "session").selectExpr(
        "session", "call_id", "name", "start_ts", "if(post_ts >= start_ts, post_ts, last_ts) as end_ts", "true as incomplete"
    )


# ---------------------------------------------------------------- matching
def match_completion_to_stream(completions: DataFrame, streams: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Completion logs with the one stream that ended near them.

    ``completions``: ``id, session, ts``; ``streams``: ``id, session, start_ts,
    end_ts``.  Near means an end from 1 ms before to 5 ms after, both included,
    and a start at most 1 ms after.  Completions take streams in the order of
    ``(ts, id)``; one takes a stream if exactly one is near that none took before,
    so a second completion can be decided by what the first took.  Any other
    completion is an incomplete instant.
    """
    pairs = lone_unused(completions, streams, "session", before=MS, after=5 * MS, slack=MS, blocks=blocks)
    return completions.join(pairs.withColumnRenamed("offer_id", "stream_id"), "id", "left").selectExpr(
        "id", "session", "stream_id", "coalesce(start_ts, ts) as start_ts", "coalesce(end_ts, ts) as end_ts",
        "stream_id is null as incomplete", "if(stream_id is null, 'unmeasured', 'native-stream') as timing",
    )


def match_prompt_log(turns: DataFrame, logs: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Prompts from turns and the prompt logs that announce them.

    ``turns``: ``id, session, start_ts, end_ts``; ``logs``: ``id, session, ts``.
    Turns in the order of ``(start_ts, id)`` take the first log from a second
    before their start to their end that none took before, nested turns included.
    Leftover logs become incomplete prompts.
    """
    pairs = first_unused(turns, logs, "session", low=f"start_ts - {1000 * MS}", high="end_ts", order=["start_ts"], blocks=blocks)
    said = pairs.join(logs.selectExpr("id as offer_id", "ts"), "offer_id").selectExpr("id", "offer_id as log_id", "ts")
    matched = turns.join(said, "id", "left").selectExpr(
        "id", "session", "log_id", "coalesce(ts, start_ts) as start_ts", "end_ts", "false as incomplete"
    )
    left = logs.join(pairs.selectExpr("offer_id as id"), "id", "left_anti").selectExpr(
        "cast(null as bigint) as id", "session", "id as log_id", "ts as start_ts", "cast(null as bigint) as end_ts", "true as incomplete"
    )
    return matched.unionByName(left)


def match_usage_sample(responses: DataFrame, samples: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """The first usage sample from 5 ms before to 1 s after a response's end
    that reports the same input and output: ``id, sample_id``."""
    keys = ["session", "input_tokens", "output_tokens"]
    # a search forward in time is a search backward on the negated clock
    left = responses.filter("input_tokens is not null and output_tokens is not null").selectExpr(
        "id", *keys, f"-(end_ts - {5 * MS}) as back_ts", "end_ts"
    )
    right = samples.selectExpr(*keys, "-ts as back_ts", "-id as tie", "id as sample_id", "ts as sample_ts")
    found = asof_last(
        left, right, keys, left_ts="back_ts", right_ts="back_ts", right_tie="tie",
        value=F.struct("sample_id", "sample_ts"), out="s", blocks=blocks,
    )
    return found.filter(f"s.sample_ts <= end_ts + {1000 * MS}").selectExpr("id", "s.sample_id as sample_id")


def exclude_control_events(prompts: DataFrame, controls: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Prompts without the ones that only steered the recording.

    For each control (``id, session, ts, length``) the nearest earlier prompt
    (same columns) of equal length within two seconds goes.
    """
    nearest = asof_last(
        controls, prompts, ["session", "length"], left_ts="ts", right_ts="ts", right_tie="id",
        value=F.struct(F.col("id").alias("pid"), F.col("ts").alias("pts")), out="p", blocks=blocks,
    )
    gone = nearest.filter(f"ts - p.pts < {2000 * MS}").selectExpr("p.pid as id")
    return prompts.join(gone, "id", "left_anti")


# ------------------------------------------------------------------ as-of
def asof_configuration(points: DataFrame, configurations: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Model, effort and provider in force at each point (``id, session, ts``):
    the latest recorded at or before it, else the session's first."""
    value = F.struct("model", "effort", "provider")
    placed = asof_last(
        points, configurations, ["session"], left_ts="ts", right_ts="ts", right_tie="id", value=value, out="c", blocks=blocks
    )
    first = configurations.groupBy("session").agg(F.min_by(value, F.struct("ts", "id")).alias("f"))
    return placed.join(first, "session", "left").withColumn("c", F.coalesce("c", "f")).select(
        *points.columns, "c.model", "c.effort", "c.provider"
    )


def asof_last_response(tools: DataFrame, responses: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Edge from the latest response that started by the time of each tool."""
    placed = asof_last(
        tools, responses, ["session"], left_ts="ts", right_ts="ts", right_tie="id", value=F.col("id"), out="response_id",
        blocks=blocks,
    )
    return placed.filter("response_id is not null").selectExpr("response_id as slice_out", "id as slice_in")


def owner_prompt_containing(points: DataFrame, prompts: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """The first prompt around each point: ``id, prompt_id``.

    Only a prompt that ends after all earlier ones can be the first around any
    point.  Those have rising ends, so the answer is the earliest end at or
    after the point: an as-of search, not a range join.
    """
    seen = running(prompts, ["session"], ["start_ts", "id"], {"_before": Run("max_before", F.col("end_ts"))}, blocks)
    records = seen.filter("_before is null or end_ts > _before").selectExpr(
        "session", "-end_ts as back_ts", "id as prompt_id", "start_ts"
    )
    left = points.selectExpr("id", "session", "ts", "-ts as back_ts")
    found = asof_last(
        left, records, ["session"], left_ts="back_ts", right_ts="back_ts", right_tie="prompt_id",
        value=F.struct("prompt_id", "start_ts"), out="p",
    )
    return found.filter("p.start_ts <= ts").selectExpr("id", "p.prompt_id as prompt_id")


def classify_by_containment(responses: DataFrame, compactions: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Add ``in_compaction``: the response lies inside a compaction of its session.

    Among compactions that start by the response's start the largest end
    decides, so a running maximum answers it.
    """
    opened = compactions.selectExpr("session", "ts as _ts", "0 as _side", "id as _tie", "end_ts as _until")
    asked = responses.select(
        "session", F.col("ts").alias("_ts"), F.lit(1).alias("_side"), F.col("id").alias("_tie"), F.struct(*responses.columns).alias("_row")
    )
    both = asked.unionByName(opened, allowMissingColumns=True)
    seen = running(both, ["session"], ["_ts", "_side", "_tie"], {"_reach": Run("max_before", F.col("_until"))}, blocks, block_order=["_ts"])
    return seen.filter("_row is not null").select(
        "_row.*", F.coalesce(F.col("_reach") >= F.col("_row.end_ts"), F.lit(False)).alias("in_compaction")
    )


# ------------------------------------------------------------------- trees
def inherit_scope_from_ancestors(spans: DataFrame) -> DataFrame:
    """Session of each span: its own, else its nearest ancestor's, else the only
    one its trace mentions.  ``spans``: ``id, parent_id, trace_id, session``."""
    found = nearest_ancestor(spans, is_stop=F.col("session").isNotNull())
    named = spans.filter("session is not null").selectExpr("id as ancestor_id", "session as inherited")
    only = spans.filter("session is not null").groupBy("trace_id").agg(
        F.min("session").alias("low"), F.max("session").alias("high")
    ).filter("low = high").selectExpr("trace_id", "low as sole")
    by_id = found.join(named, "ancestor_id").select("id", "inherited")
    return spans.join(by_id, "id", "left").join(only, "trace_id", "left").select(
        "id", "trace_id", F.coalesce("inherited", "sole").alias("session")
    )


def nearest_mapped_ancestor_edges(spans: DataFrame) -> DataFrame:
    """Edges from each mapped span's nearest mapped proper ancestor, unless the
    child starts first.  ``spans``: ``id, parent_id, start_ts, mapped``."""
    upward = nearest_ancestor(spans, is_stop=F.col("mapped")).selectExpr("id as parent_id", "ancestor_id as slice_out")
    starts = spans.filter("mapped").selectExpr("id as slice_out", "start_ts as out_ts")
    return (
        spans.filter("mapped and parent_id is not null").join(upward, "parent_id").join(starts, "slice_out")
        .filter("start_ts >= out_ts").selectExpr("slice_out", "id as slice_in")
    )


def route_telemetry(spans: DataFrame, captures: DataFrame) -> DataFrame:
    """Which capture may store each span, from a shared export.

    ``spans``: ``id, parent_id, trace_id, session, start_ts, end_ts``;
    ``captures``: ``session, capture_id, start_ts, end_ts`` (null: running).
    ``state`` is ``stored``, ``outside`` (other session or window: never
    stored) or ``waiting`` (owner not known yet).
    """
    owned = inherit_scope_from_ancestors(spans).withColumnRenamed("session", "owner").select("id", "owner")
    windows = captures.selectExpr("session as owner", "capture_id", "start_ts as c0", "end_ts as c1")
    placed = spans.join(owned, "id", "left").join(windows, "owner", "left")
    fits = "coalesce(end_ts >= c0 and (c1 is null or start_ts <= c1), false)"
    per_span = placed.groupBy("id", "owner").agg(F.expr(f"min(if({fits}, capture_id, null)) as capture_id"))
    return per_span.selectExpr(
        "id", "owner as session", "capture_id",
        "case when capture_id is not null then 'stored' when owner is null then 'waiting' else 'outside' end as state",
    )


def reachable_sessions(links: DataFrame, roots: DataFrame, readable: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Sessions reached from each root over recorded child links.

    ``links``: ``parent, child``; ``roots``: ``session``; ``readable``:
    ``session``.  Unreadable sessions count as missing, and with a ``limit``
    those beyond it too: ``seed, sessions, missing``.
    """
    known = readable.select(F.col("session").alias("id")).distinct()
    # an unreadable session has no links of its own
    edges = links.selectExpr("parent as parent_id", "child as id").join(known.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi")
    edges = cut_lineage(edges.filter("id is not null").distinct())
    seeds = roots.selectExpr("session as seed").distinct()
    if edges.groupBy("id").count().filter("count > 1").isEmpty():
        # a forest, with a ring at some roots: what lies below is summed, and no closure is written
        ids = seeds.selectExpr("seed as id").union(edges.select("id")).union(edges.select("parent_id")).distinct()
        nodes = ids.join(edges, "id", "left").join(known.withColumn("ok", F.lit(True)), "id", "left")
        below = descendant_totals(nodes, {"found": F.expr("if(ok, 1, 0)"), "unread": F.expr("if(ok, 0, 1)")})
        counted = below.withColumnRenamed("id", "seed").join(seeds, "seed", "left_semi")
    else:
        # sessions with several parents are counted once however they are reached
        reached = expand_edges(edges, seeds).join(known.withColumn("ok", F.lit(True)), "id", "left")
        counted = reached.groupBy("seed").agg(F.expr("count_if(ok) as found"), F.expr("count_if(ok is null) as unread"))
    held = "found" if limit is None else f"least(found, {limit}L)"
    return counted.selectExpr("seed", f"{held} as sessions", f"unread + found - {held} as missing")


def link_delegations(launches: DataFrame, children: DataFrame, inputs: DataFrame) -> DataFrame:
    """Launch tools with the child session they started and its first input.

    ``launches``: ``id, session, call_id, child_session, ts``; ``children``:
    ``session, parent_session, launch_call``; ``inputs``: ``id, session, ts``.
    The call id decides, else the session named in the launch output.
    """
    kids = children.filter("parent_session is not null")
    by_call = launches.filter("call_id is not null").join(
        kids.selectExpr("session as child", "parent_session as session", "launch_call as call_id"), ["session", "call_id"]
    ).selectExpr("id", "session", "child", "ts", "0 as tier")
    by_name = launches.join(
        kids.selectExpr("session as child", "parent_session as session", "session as child_session"), ["session", "child_session"]
    ).selectExpr("id", "session", "child", "ts", "1 as tier")
    best = by_call.unionByName(by_name).groupBy("child").agg(F.min(F.struct("tier", "ts", "id", "session")).alias("l"))
    first = inputs.groupBy("session").agg(F.min_by("id", F.struct("ts", "id")).alias("first_input")).withColumnRenamed("session", "child")
    return best.join(first, "child", "left").selectExpr(
        "l.id as launch_id", "l.session as session", "child as child_session", "first_input"
    )


# ---------------------------------------------------------- states and series
def run_configuration_changes(rows: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Intervals of constant configuration: ``session, ts, id, model, effort``
    in, ``session, start_ts, end_ts, model, effort`` out; the last one is open."""
    config = F.struct("model", "effort")
    seen = running(rows, ["session"], ["ts", "id"], {"_first": Run("row_number"), "_was": Run("lag", config)}, blocks)
    changed = seen.filter("_first = 1 or not (struct(model, effort) <=> _was)").drop("_first", "_was")
    return running(changed, ["session"], ["ts", "id"], {"end_ts": Run("lead", F.col("ts"))}, blocks).selectExpr(
        "session", "ts as start_ts", "end_ts", "model", "effort"
    )


def cumulative_counters(responses: DataFrame, bounds: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Running token totals per session as counter samples.

    ``responses``: ``session, id, end_ts, input_tokens, output_tokens``;
    ``bounds``: ``session, start_ts, end_ts``.  Each counter opens and closes
    at zero; unknown usage makes no sample.
    """
    totals = running(
        responses, ["session"], ["end_ts", "id"],
        {"input_total": Run("sum", F.col("input_tokens")), "output_total": Run("sum", F.col("output_tokens"))}, blocks,
    )
    samples = totals.selectExpr(
        "session",
        """inline(filter(array(
             if(input_tokens is not null, struct('llm.tokens.input' as name, end_ts as ts, input_total as value), null),
             if(output_tokens is not null, struct('llm.tokens.output' as name, end_ts as ts, output_total as value), null)
           ), s -> s is not null))""",
    )
    edges = bounds.selectExpr(
        "session",
        """inline(array(
             struct('llm.tokens.input' as name, start_ts as ts, 0L as value), struct('llm.tokens.output' as name, start_ts as ts, 0L as value),
             struct('llm.tokens.input' as name, end_ts as ts, 0L as value), struct('llm.tokens.output' as name, end_ts as ts, 0L as value)))""",
    )
    return samples.unionByName(edges)


def context_gauge(responses: DataFrame, compactions: DataFrame, *, with_cache: bool = True) -> DataFrame:
    """Context size samples: a response's input, with the cache when both cache
    sides are known; a compaction's sizes, and 0 (unknown) after one that
    completed without an estimate."""
    size = "input_tokens + cache_read_tokens + cache_write_tokens" if with_cache else "input_tokens"
    read = responses.selectExpr("session", "end_ts as ts", f"{size} as value").filter("value is not null")
    before = compactions.filter("before_tokens is not null").selectExpr("session", "start_ts as ts", "before_tokens as value")
    after = compactions.filter("not incomplete or after_tokens is not null").selectExpr(
        "session", "end_ts as ts", "coalesce(after_tokens, 0L) as value"
    )
    return read.unionByName(before).unionByName(after)


def clip_to_capture(slices: DataFrame, windows: DataFrame) -> DataFrame:
    """Slices inside their capture's window; clipped ones become incomplete."""
    w = windows.selectExpr("session", "start_ts as w0", "end_ts as w1")
    inside = slices.join(w, "session").filter("end_ts >= w0 and start_ts <= w1")
    kept = [c for c in slices.columns if c not in ("start_ts", "end_ts", "incomplete")]
    return inside.selectExpr(
        *kept, "greatest(start_ts, w0) as start_ts", "least(end_ts, w1) as end_ts",
        "incomplete or start_ts < w0 or end_ts > w1 as incomplete",
    )


def session_bounds(evidence: DataFrame, process: DataFrame) -> DataFrame:
    """Bounds of each session over all its evidence (``recording, session,
    start_ts, end_ts``); the primary session spans the whole process
    (``recording, session, start_ts, end_ts``)."""
    return evidence.unionByName(process).groupBy("recording", "session").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")
    )


def segment_revisited_sessions(rows: DataFrame) -> DataFrame:
    """Give a session that is visited again a name of its own per segment; the
    segment seen first keeps the plain one.  ``rows``: ``session, segment, ts, ...``."""
    first = rows.groupBy("session").agg(F.min_by("segment", F.struct("ts", "segment")).alias("_first"))
    return rows.join(first, "session").select(
        *[c for c in rows.columns if c != "session"],
        F.col("session").alias("native_session"),
        F.when(F.col("segment") == F.col("_first"), F.col("session"))
        .otherwise(F.concat("session", F.lit(":"), F.col("segment").cast("string"))).alias("session"),
    )


def lifecycle_snapshots_to_spans(snapshots: DataFrame, finals: DataFrame) -> DataFrame:
    """Model calls seen in repeated snapshots: ``script, call_id, name, status, ts``.

    A call starts when first seen running; seen only finished, it makes no
    span.  Calls still running at the script's end (``finals``: ``script,
    end_ts``) are incomplete.
    """
    calls = snapshots.filter(
        "name in ('models.classify', 'models.generateImages') and status in ('running', 'ok', 'error', 'cancelled')"
    ).groupBy("script", "call_id").agg(
        F.expr("min(ts) filter (where status = 'running') as start_ts"),
        F.expr("min(struct(ts, status)) filter (where status != 'running') as done"),
        F.min_by("name", "ts").alias("name"),
    ).filter("start_ts is not null and (done is null or done.ts >= start_ts)")
    return calls.join(finals, "script", "left").selectExpr(
        "script", "call_id", "name", "start_ts", "coalesce(done.ts, end_ts) as end_ts",
        "coalesce(done.status, 'interrupted') as status", "if(done is null, null, done.status != 'ok') as is_error",
        "done is null as incomplete",
    )


def close_partial_recording(events: DataFrame, counters: DataFrame) -> DataFrame:
    """Close what an interrupted stream left open.

    ``events``: ``track_id, id, phase, ts`` where an end closes the innermost
    begin of its track; ``counters``: ``track_id, ts, value``.  Returns the end
    rows (``type = 'end'``) and counter zeros (``type = 'zero'``) to append just
    after the last event.
    """
    last = events.select("ts").unionByName(counters.select("ts")).agg((F.max("ts") + 1).alias("cutoff"))
    step = F.when(F.col("phase") == "begin", 1).otherwise(-1)
    depth = running(events, ["track_id"], ["ts", "id"], {"depth": Run("sum", step)})
    # a begin is open if the track never falls below its depth again
    lowest = running(
        depth.select("track_id", "id", "phase", "depth", (-F.col("ts")).alias("_back"), (-F.col("id")).alias("_tie")),
        ["track_id"], ["_back", "_tie"], {"_later": Run("max_before", -F.col("depth"))},
    )
    open_ = lowest.filter("phase = 'begin' and (_later is null or -_later >= depth)").selectExpr("track_id", "id", "'end' as type")
    zeros = counters.select("track_id").distinct().selectExpr("track_id", "cast(null as bigint) as id", "'zero' as type")
    return open_.unionByName(zeros).crossJoin(F.broadcast(last)).selectExpr(  # one row
        "track_id", "id", "type", "cutoff as ts", "type = 'end' as incomplete"
    )


def align_clocks(rows: DataFrame, snapshots: DataFrame, *, blocks: Blocks | None = None) -> DataFrame:
    """Wall time of source-clock rows (``recording, clock, id, ts``) from the
    recording's own snapshots (``recording, clock, id, source_ts, realtime``):
    the latest at or before a row, else the first.  Rows without any stay
    unplaced and are counted by the import statistics."""
    keys = ["recording", "clock"]
    offset = F.col("realtime") - F.col("source_ts")
    placed = asof_last(
        rows, snapshots, keys, left_ts="ts", right_ts="source_ts", right_tie="id", value=offset, out="offset", blocks=blocks
    )
    first = snapshots.groupBy(*keys).agg(F.min_by(offset, F.struct("source_ts", "id")).alias("first_offset"))
    return placed.join(first, keys, "left").selectExpr(
        *rows.columns, "ts + coalesce(offset, first_offset) as realtime", "coalesce(offset, first_offset) is null as unresolved"
    )


def union_recordings(slices: Sequence[DataFrame] | DataFrame, machines: DataFrame) -> DataFrame:
    """One table from many recordings (``recording, local_id, local_parent, ...``)
    with ids unique over all of them.

    The new id is a hash of recording and local id, so files need no common
    numbering pass.  Fails when the recordings come from several machines.
    """
    one = slices if isinstance(slices, DataFrame) else _union(slices)

    def unique(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.xxhash64("recording", column))

    # evaluated with the data: no extra action, and no mixed output
    check = machines.agg(F.countDistinct("machine_id").alias("n")).select(
        F.when(F.col("n") > 1, F.raise_error(F.lit("recordings from several machines"))).cast("int").alias("_one_machine")
    )
    return one.crossJoin(F.broadcast(check)).filter("_one_machine is null").drop("_one_machine").withColumns(
        {"id": unique("local_id"), "parent_id": unique("local_parent")}
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def native_usage_totals(usage: DataFrame) -> DataFrame:
    """Usage totals per run from the harness's own events; here an absent
    number does count as zero, for reconciliation."""
    fields = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    return usage.groupBy("run").agg(*[F.expr(f"sum(coalesce({f}, 0L)) as {f}") for f in fields])


def read_transcripts(lines: DataFrame) -> DataFrame:
    """Records of session transcripts that belong to the session itself.

    ``lines``: ``file, session, seq, type, thread_id, payload_id``.  A forked
    transcript embeds its parent's history: after a second header records belong
    to nobody until a usage record names its owner.
    """
    header = F.col("type") == "session_meta"
    heads = running(lines, ["file"], ["seq"], {"_heads": Run("sum", header.cast("long"))})
    owner = (
        F.when(header & (F.col("_heads") == 1), F.struct(F.col("payload_id").alias("v")))
        .when(header, F.struct(F.lit("").alias("v")))
        .when(F.col("type") == "token_usage_record", F.struct(F.col("thread_id").alias("v")))
    )
    owned = running(heads.withColumn("_set", owner), ["file"], ["seq"], {"_owner": Run("last", F.col("_set"))})
    return owned.filter("_heads >= 1 and _owner.v = session").drop("_heads", "_set", "_owner")
