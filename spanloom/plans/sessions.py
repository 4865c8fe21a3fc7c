"""Sessions: who launched whom, and roll-ups over the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom import schema
from spanloom.functions.attributes import total_sql
from spanloom.operators.intervals import interval_sweep
from spanloom.operators.trees import expand_edges, roots
from spanloom.plans.models import RATED
from spanloom.plans.trace import AgentTrace, view



@view(keep=True)
def session_captures(t: AgentTrace) -> DataFrame:
    """Bounds and delegation evidence per capture and session."""
    return t["slices"].groupBy("capture_id", "session").agg(
        F.expr("min(ts) as start_ts"),
        F.expr("max(ts + greatest(dur, 0L)) as end_ts"),
        F.expr("max(attrs.parent_session) as parent_session"),
        F.expr("bool_or(attrs.parent_session is not null or attrs.child_role is not null) as is_subagent"),
        F.expr("max(attrs.child_role) as child_role"),
        F.expr("max(attrs.subagent_type) as subagent_type"),
    )


@view()
def capture_parents(t: AgentTrace) -> DataFrame:
    """The parent of a capture, when the best kind of evidence names exactly one.

    Evidence, best first: a recorded flow from a tool into the capture's first
    input; a launch that names the session; the session's own parent name.  The
    last two need the child to start inside the parent's bounds.
    """
    ends = t["slices"].selectExpr("id", "capture_id", "kind", "name")
    tools = ends.filter("kind = 'tool-execution'").selectExpr("id as slice_out", "capture_id as parent")
    inputs = ends.filter("name = 'prompt-input'").selectExpr("id as slice_in", "capture_id as child")
    by_flow = t.tables["flow"].join(inputs.hint("merge"), "slice_in").join(tools.hint("merge"), "slice_out").filter("parent != child").selectExpr(
        "child", "parent", "0 as tier"
    )

    s = t["session_captures"]
    child = s.selectExpr("capture_id as child", "session as child_session", "start_ts as child_ts", "parent_session")
    parent = s.selectExpr("capture_id as parent", "session as own_session", "start_ts", "end_ts")
    inside = "child != parent and child_ts between start_ts and end_ts"
    launches = t["slices"].filter("attrs.child_session is not null").selectExpr(
        "attrs.child_session as child_session", "capture_id as parent"
    ).distinct()
    by_launch = (
        launches.join(child, "child_session")
        .join(parent, "parent")
        .filter(f"{inside} and (parent_session is null or parent_session = own_session)")
        .selectExpr("child", "parent", "1 as tier")
    )
    by_name = (
        child.join(parent, F.col("parent_session") == F.col("own_session"))
        .filter(inside)
        .selectExpr("child", "parent", "2 as tier")
    )
    # smallest and largest parent of the best tier: equal means there is only one
    best = by_flow.unionByName(by_launch).unionByName(by_name).groupBy("child").agg(
        F.expr("min(struct(tier, parent)).parent as low"), F.expr("max(struct(-tier, parent)).parent as high")
    )
    return best.filter("low = high").selectExpr("child as capture_id", "low as parent_capture_id")


@view(keep=True)
def capture_hierarchy(t: AgentTrace) -> DataFrame:
    """Parent and root of each capture; cycles and ambiguous captures stay roots."""
    s = t["session_captures"].select("capture_id", "is_subagent")
    linked = s.join(t["capture_parents"], "capture_id", "left")
    nodes = linked.groupBy("capture_id").agg(F.max("parent_capture_id").alias("parent_capture_id"))
    found = roots(nodes, node="capture_id", parent="parent_capture_id")
    return linked.join(found, "capture_id").selectExpr(
        "capture_id", "root as root_capture_id", "parent_capture_id",
        "coalesce(is_subagent, false) or parent_capture_id is not null as is_subagent",
    )


def capture_descendants(t: AgentTrace, selected: DataFrame) -> DataFrame:
    """All captures below the selected ones: ``seed, capture_id, depth``."""
    edges = t["capture_hierarchy"].filter("parent_capture_id is not null").selectExpr(
        "parent_capture_id as parent_id", "capture_id as id"
    )
    return expand_edges(edges, selected.selectExpr("capture_id as seed")).selectExpr("seed", "id as capture_id", "depth")


@view()
def workspace_tracks(t: AgentTrace) -> DataFrame:
    """One row per track and capture with how its process and session are shared."""
    own = t["slices"].groupBy("capture_id", "session").agg(F.min("upid").alias("upid")).join(
        t["capture_hierarchy"].groupBy("capture_id").agg(F.expr("bool_or(is_subagent) as is_subagent")), "capture_id"
    )
    per_process = own.groupBy("upid").agg(
        F.expr("count(distinct capture_id) as process_captures"),
        F.expr("count(distinct session) as process_sessions"),
        F.expr("bool_and(is_subagent) as all_subagents"),
    )
    per_session = own.groupBy("session").agg(F.expr("count(distinct upid) as session_processes"))
    # a track and capture agree on the rest; the earliest slice id breaks ties
    rows = t["slices"].groupBy("track_id", "capture_id").agg(
        F.min_by(F.struct("upid", "utid", "session", "capture", "track_name"), F.col("id")).alias("f")
    ).select("track_id", "capture_id", "f.*")
    flags = t["capture_hierarchy"].groupBy("capture_id").agg(F.expr("bool_or(is_subagent) as is_subagent"))
    return (
        rows.join(flags, "capture_id")
        .join(per_process, "upid", "left")
        .join(per_session, "session", "left")
        .join(t["captures"].selectExpr("capture_id", "label as capture_label"), "capture_id", "left")
        .selectExpr(
            "track_id", "capture_id", "upid", "utid", "session", "capture", "capture_label", "track_name",
            "coalesce(process_captures, 0L) as process_captures", "is_subagent",
            "coalesce(all_subagents, false) as all_subagents",
            "process_sessions = 1 and session_processes = 1 as single_agent",
        )
    )


@view()
def delegation(t: AgentTrace) -> DataFrame:
    """Hierarchy with bounds and how long a child's extent overlaps its parent's."""
    runs = t["capture_runs"].select("capture_id", "harness", "start_ts", "end_ts", "duration_ms")
    parent = t["capture_runs"].selectExpr(
        "capture_id as parent_capture_id", "start_ts as parent_start_ts", "end_ts as parent_end_ts"
    )
    rows = runs.join(t["capture_hierarchy"], "capture_id").join(parent, "parent_capture_id", "left")
    return rows.selectExpr(
        "capture_id", "root_capture_id", "parent_capture_id", "is_subagent", "harness", "start_ts", "end_ts",
        "duration_ms as retained_extent_ms", "parent_start_ts", "parent_end_ts",
        # least() skips nulls, so an absent parent must be excluded first
        """case when parent_start_ts is not null then
             greatest(0L, least(end_ts, parent_end_ts) - greatest(start_ts, parent_start_ts)) / 1e6D
           end as parent_child_extent_overlap_ms""",
    )


@view()
def child_launches(t: AgentTrace) -> DataFrame:
    """Spans that launched a child agent."""
    rows = t["slices"].filter(
        "category = 'pi.workflow' or attrs.delegation = 1 or attrs.child_session is not null"
    )
    return rows.selectExpr(
        "id", "capture_id", "session", "ts", "dur", "name", "incomplete", "dur / 1e6D as launch_duration_ms",
        "if(not incomplete and dur >= 0, dur / 1e6D, null) as launch_lifecycle_ms",
        "attrs.child_session as child_session",
        "coalesce(attrs.subagent_type, attrs.child_role, attrs.role) as child_role",
        "attrs.parent_session as parent_session", "attrs.correlation as correlation",
    )


def _first_prompts(t: AgentTrace) -> DataFrame:
    """First prompt with text of each capture, with its whole text."""
    rows = t["slices"].filter("name = 'prompt' and trim(coalesce(attrs.text, '')) != ''")
    # the choice is made on narrow rows; only the chosen prompts' texts are read
    first = rows.groupBy("capture_id").agg(F.expr("min(struct(ts, id)).id as prompt_id"))
    text = t.tables["slice"].selectExpr("id as prompt_id", "attrs.text as prompt_text")
    return first.join(text, "prompt_id").select("capture_id", "prompt_id", "prompt_text")


def _identities(rows: DataFrame, key: str) -> DataFrame:
    """Distinct (provider, model) pairs as sorted JSON, nulls shown."""
    return rows.groupBy(key).agg(
        F.expr("to_json(array_sort(collect_set(struct(provider, model))), map('ignoreNullFields', 'false')) as model_identities")
    )


def _model_load(messages: DataFrame, key: str, blocks) -> tuple[DataFrame, DataFrame]:
    """Output rate, and busy time with peak of concurrent responses."""
    rates = messages.groupBy(key).agg(
        F.expr(
            f"sum(output_tokens) filter (where {RATED}) * 1e9D / {total_sql('message_ns', RATED)} as tokens_per_s"
        )
    )
    spans = messages.filter("message_ns > 0 and not incomplete").selectExpr(
        key, "message_start_ts as ts", "message_start_ts + message_ns as end_ts", "1 as active"
    )
    busy = interval_sweep(spans, [key], ["active"], blocks=blocks).groupBy(key).agg(
        F.expr("sum(dur) filter (where active > 0 and dur > 0) / 1e6D as model_busy_ms"),
        F.expr("max(active) filter (where active > 0 and dur > 0) as peak_model_responses"),
    )
    return rates, busy


@view()
def root_sessions(t: AgentTrace) -> DataFrame:
    """Each root session with the totals of all captures below it."""
    h = t["capture_hierarchy"].select("capture_id", "root_capture_id")
    totals = t["capture_runs"].join(h, "capture_id").groupBy("root_capture_id").agg(
        F.expr("min(start_ts) as start_ts"),
        F.expr("(max(end_ts) - min(start_ts)) / 1e6D as duration_ms"),
        *[
            F.sum(c).alias(c)
            for c in ("turns", "responses", "tools", "incomplete", "input_tokens", "output_tokens")
        ],
        *[F.max(c).alias(c) for c in ("peak_context", "context_window_tokens", "context_share")],
        F.expr("count(*) - 1 as subagents"),
    ).withColumnRenamed("root_capture_id", "capture_id")
    own = h.filter("capture_id = root_capture_id").select("capture_id").join(
        t["configuration"].drop("session_labels", "id"), "capture_id", "left"
    )
    missing = schema.NOT_RECORDED
    config = own.groupBy("capture_id").agg(
        *[
            F.expr(f"array_join(array_sort(collect_set(coalesce({c}, '{missing}'))), ',') as {c}")
            for c in ("harness", "provider", "model", "effort")
        ]
    ).join(_identities(own, "capture_id"), "capture_id")
    at_root = t["messages"].join(h, "capture_id").drop("capture_id").withColumnRenamed("root_capture_id", "capture_id")
    blocks = t.blocks("root_capture_id").renamed("capture_id")
    rates, busy = _model_load(at_root, "capture_id", blocks)
    identity = t["capture_runs"].select("capture_id", "session", "capture", "recorded_id", "session_labels")
    return (
        totals.join(identity, "capture_id")
        .join(config, "capture_id")
        .join(_first_prompts(t), "capture_id", "left")
        .join(rates, "capture_id", "left")
        .join(busy, "capture_id", "left")
    )


@view()
def session_details(t: AgentTrace) -> DataFrame:
    """Each capture, root or subagent, with its role."""
    roles = t["session_captures"].groupBy("capture_id").agg(F.max("subagent_type").alias("subagent_type"))
    rates, busy = _model_load(t["messages"], "capture_id", t.blocks("capture_id"))
    rows = (
        t["capture_runs"]
        .join(t["capture_hierarchy"], "capture_id")
        .join(roles, "capture_id")
        .join(_identities(t["configuration"], "capture_id"), "capture_id", "left")
        .join(_first_prompts(t), "capture_id", "left")
        .join(rates, "capture_id", "left")
        .join(busy, "capture_id", "left")
    )
    role = """case when not is_subagent then 'Primary'
        when nullif(subagent_type, '') is not null then concat('Subagent · ', subagent_type) else 'Subagent' end as role"""
    return rows.selectExpr(
        "capture_id", "root_capture_id", "parent_capture_id", "session", "capture", "recorded_id", "prompt_id",
        "prompt_text", "is_subagent", role, "harness", "provider", "model", "model_identities", "effort",
        "session_labels", "input_tokens", "output_tokens", "peak_context", "context_window_tokens", "context_share",
        "tokens_per_s", "model_busy_ms", "peak_model_responses", "duration_ms", "turns", "responses", "tools", "incomplete",
    )


@view()
def flow_pairs(t: AgentTrace) -> DataFrame:
    """How many recorded edges join each pair of operation kinds.

    Both joins are on all operations: a few columns of a wide table look small to
    the planner, which would otherwise collect them on the driver to broadcast them.
    """
    ends = t["slices"].select("id", "kind", "capture_id")
    out = ends.selectExpr("id as slice_out", "kind as from_kind", "capture_id as from_capture")
    into = ends.selectExpr("id as slice_in", "kind as to_kind", "capture_id as to_capture")
    return t.tables["flow"].join(out.hint("merge"), "slice_out").join(into.hint("merge"), "slice_in").groupBy("from_kind", "to_kind").agg(
        F.expr("count(*) as flows"), F.expr("count_if(from_capture != to_capture) as across_captures")
    )
