"""Turns: which prompt each operation belongs to, and what a turn cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.operators.blocks import Run, running
from spanloom.operators.intervals import asof_last, count_overlaps, innermost, interval_sweep, islands, overlap_pairs
from spanloom.operators.trees import nearest_ancestor
from spanloom.plans.trace import AgentTrace, view

#: Strength of the evidence for an owner, best first.
TIER_NATIVE, TIER_FLOW, TIER_FLOW_TWO, TIER_ANCESTRY, TIER_CONTAINMENT = 0, 10, 20, 100, 1000

WORK_KINDS = ("assistant-message", "provider-request", "tool-execution", "script", "model-call")


@view(keep=True)
def turn_prompts(t: AgentTrace) -> DataFrame:
    """Prompts with their number and bounds.  An open prompt ends with its
    capture; an incomplete one owns work only until the next prompt."""
    runs = t["capture_runs"].selectExpr("capture_id", "start_ts as capture_start_ts", "end_ts as capture_end_ts")
    prompts = (
        t["slices"]
        .filter("kind = 'prompt'")
        .selectExpr(
            "id as prompt_id", "capture_id", "session", "capture", "ts as start_ts", "dur", "incomplete",
            "attrs.turn_id as native_turn_id",
        )
        .join(runs, "capture_id", "left")
    )
    ordered = running(
        prompts, ["capture_id"], ["start_ts", "prompt_id"],
        {"next_start_ts": Run("lead", F.col("start_ts")), "turn_number": Run("row_number")},
        t.blocks("capture_id"),
    )
    recorded = ordered.withColumn("recorded_end_ts", F.expr("if(dur >= 0, start_ts + dur, capture_end_ts)"))
    ended = "coalesce(recorded_end_ts, start_ts)"
    return recorded.selectExpr(
        "prompt_id", "capture_id", "session", "capture", "start_ts", "capture_start_ts", "incomplete", "recorded_end_ts",
        "next_start_ts", "turn_number", "native_turn_id",
        f"if(incomplete, least({ended}, coalesce(next_start_ts, {ended})), {ended}) as attribution_end_ts",
    )


@view()
def prompt_cluster_members(t: AgentTrace) -> DataFrame:
    """Prompts with the number of their group of overlapping prompts."""
    return islands(
        t["turn_prompts"], ["capture_id"], start="start_ts", end="attribution_end_ts", tie="prompt_id",
        blocks=t.blocks("capture_id"),
    )


@view()
def prompt_clusters(t: AgentTrace) -> DataFrame:
    """Groups of overlapping prompts with bounds and size."""
    return t["prompt_cluster_members"].groupBy("capture_id", "cluster_id").agg(
        F.min("start_ts").alias("start_ts"), F.max("attribution_end_ts").alias("end_ts"), F.count(F.lit(1)).alias("prompts")
    )


@view(keep=True)
def turn_work(t: AgentTrace) -> DataFrame:
    """Operations a prompt can own."""
    rows = t["slices"].filter(F.col("kind").isin(list(WORK_KINDS)) | F.expr("attrs.child_session is not null"))
    message = "kind = 'assistant-message'"
    return rows.selectExpr(
        "id", "capture_id", "kind", "incomplete",
        f"if({message} and dur <= 0, coalesce(ts - attrs.duration_ns, ts), ts) as start_ts",
        f"""case when incomplete then null
                 when {message} then if(dur > 0, dur, attrs.duration_ns)
                 when dur >= 0 then dur end as measured_ns""",
        *[f"if({message}, attrs.{c}, null) as {c}" for c in ("provider", "model", "input_tokens", "output_tokens")],
        "attrs.turn_id as native_turn_id", "attrs.request_id as request_id", "attrs.child_session as child_session",
    )


@view()
def native_prompts(t: AgentTrace) -> DataFrame:
    """Recorded turn ids that name exactly one prompt of their capture."""
    return (
        t["turn_prompts"].filter("native_turn_id is not null").groupBy("capture_id", "native_turn_id")
        .agg(F.min("prompt_id").alias("prompt_id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    )


@view(keep=True)
def turn_flows(t: AgentTrace) -> DataFrame:
    """Distinct flows that touch an operation or a prompt."""
    ids = t["turn_work"].select("id").unionByName(t["turn_prompts"].selectExpr("prompt_id as id")).distinct()
    flow = t.tables["flow"].distinct()
    out = ids.selectExpr("id as slice_out", "true as out_known")
    into = ids.selectExpr("id as slice_in", "true as in_known")
    return (
        flow.join(out, "slice_out", "left").join(into, "slice_in", "left")
        .filter("out_known or in_known").select("slice_out", "slice_in")
    )


@view()
def prompt_ancestry(t: AgentTrace) -> DataFrame:
    """Slices below a prompt along native parents, never across a nested prompt
    or into another capture.  Only tracks that hold a prompt are walked."""
    tracks = t["slices"].filter("kind = 'prompt'").select("track_id").distinct()
    agent = t["slices"].selectExpr("id", "capture_id as own", "kind = 'prompt' as is_prompt")
    marks = t["capture_markers"].selectExpr("slice_id as id", "capture_id as marked")
    nodes = (
        t.tables["slice"].select("id", "parent_id", "track_id").join(tracks, "track_id", "left_semi")
        .join(agent, "id", "left").join(marks, "id", "left")
    )
    found = nearest_ancestor(
        nodes,
        is_stop=F.col("is_prompt"),
        carry={
            "low": ("min", F.expr("least(own, marked)")),
            "high": ("max", F.expr("greatest(own, marked)")),
        },
    )
    prompts = t["turn_prompts"].selectExpr("prompt_id as ancestor_id", "capture_id")
    return found.join(prompts, "ancestor_id").filter(
        "coalesce(low, capture_id) = capture_id and coalesce(high, capture_id) = capture_id"
    ).selectExpr("id", "ancestor_id as prompt_id", "capture_id")


def _containment(t: AgentTrace) -> DataFrame:
    """The innermost prompt around the start of each operation: it must both
    start last and end first among the prompts that contain the point.

    Which prompt that is changes only where a prompt starts or ends.  It is found
    for each such edge; an as-of scan then hands operations the choice of theirs.
    Operations never carry the members of a group, and a group of any size has
    owners.  Two different ids of one choice stand for an undecided owner.
    """
    choices = innermost(
        t["prompt_cluster_members"], ["capture_id"], group="cluster_id", start="start_ts", end="attribution_end_ts", id_col="prompt_id",
        blocks=t.blocks("capture_id"),
    )
    work = t["turn_work"].select("id", "capture_id", "start_ts")
    placed = asof_last(
        work, choices, ["capture_id"], left_ts="start_ts", right_ts="edge_ts", right_tie="edge_ts",
        value=F.struct("edge_ts", "at", "after"), out="edge", blocks=t.blocks("capture_id"),
    )
    return placed.selectExpr("id", "inline(if(start_ts = edge.edge_ts, edge.at, edge.after))")


@view(keep=True)
def turn_owners(t: AgentTrace) -> DataFrame:
    """The prompt that owns each operation, if its best evidence names exactly one."""
    work = t["turn_work"].select("id", "capture_id")
    prompts = t["turn_prompts"].select("prompt_id", "capture_id")
    flows = t["turn_flows"]
    native = (
        t["turn_work"].select("id", "capture_id", "native_turn_id").join(t["native_prompts"], ["capture_id", "native_turn_id"])
        .selectExpr("id", "prompt_id", f"{TIER_NATIVE} as tier")
    )
    hop = work.selectExpr("id as slice_in", "capture_id")
    span = [F.min("prompt_id").alias("low"), F.max("prompt_id").alias("high")]
    direct = (
        flows.join(prompts.withColumnRenamed("prompt_id", "slice_out"), "slice_out")
        .join(hop, ["slice_in", "capture_id"]).selectExpr("slice_in as id", "slice_out as prompt_id", "capture_id")
        # a busy operation passes on two prompts at most, not every one it hears from
        .groupBy("id", "capture_id").agg(*span)
    )
    second = (
        flows.join(direct.withColumnRenamed("id", "slice_out"), "slice_out")
        .join(hop, ["slice_in", "capture_id"]).selectExpr("slice_in as id", f"{TIER_FLOW_TWO} as tier", "low", "high")
    )
    ancestry = t["prompt_ancestry"].join(work, ["id", "capture_id"]).selectExpr("id", "prompt_id", f"{TIER_ANCESTRY} as tier")
    lone = native.unionByName(ancestry)
    candidates = (
        lone.selectExpr("id", "tier", "prompt_id as low", "prompt_id as high")
        .unionByName(direct.selectExpr("id", f"{TIER_FLOW} as tier", "low", "high"))
        .unionByName(second)
        .unionByName(_containment(t).selectExpr("id", f"{TIER_CONTAINMENT} as tier", "low", "high"))
    )
    # the smallest and largest prompt of the best tier agree iff there is one
    best = candidates.groupBy("id").agg(
        F.expr("min(struct(tier, low)).low as low"), F.expr("max(struct(-tier, high)).high as high")
    )
    return best.filter("low = high").selectExpr("id", "low as prompt_id")


@view(keep=True)
def explicit_requests(t: AgentTrace) -> DataFrame:
    """Provider requests and responses joined by a flow, in either direction."""
    requests = t["turn_work"].filter("kind = 'provider-request'").selectExpr("id as request_slice_id", "capture_id")
    responses = t["turn_work"].filter("kind = 'assistant-message'").selectExpr("id as message_slice_id", "capture_id")
    ends = t["turn_flows"].selectExpr(
        """inline(array(struct(slice_out as request_slice_id, slice_in as message_slice_id),
                        struct(slice_in as request_slice_id, slice_out as message_slice_id)))"""
    )
    return (
        ends.join(requests, "request_slice_id").join(responses, ["message_slice_id", "capture_id"])
        .select("request_slice_id", "message_slice_id").distinct()
    )


def _identified(t: AgentTrace, kind: str, linked_as: str) -> DataFrame:
    """Measured operations with a request id, outside the recorded links."""
    return (
        t["turn_work"].filter(F.col("kind") == kind).filter("request_id is not null and measured_ns >= 0")
        .join(t["explicit_requests"].select(F.col(linked_as).alias("id")), "id", "left_anti")
        .selectExpr("id", "capture_id", "request_id", "start_ts as ts", "start_ts + measured_ns as end_ts")
    )


@view()
def request_matches(t: AgentTrace) -> DataFrame:
    """Requests and responses of a capture that name the same request id and overlap, as pairs."""
    requests = _identified(t, "provider-request", "request_slice_id")
    responses = _identified(t, "assistant-message", "message_slice_id")
    pairs = overlap_pairs(requests, responses, ["capture_id", "request_id"])
    return pairs.selectExpr("left_id as request_slice_id", "right_id as message_slice_id")


@view()
def request_match_counts(t: AgentTrace) -> DataFrame:
    """How many responses with its request id each request overlaps, and which
    one if it is the only one; and the same seen from the responses.

    Counted from running totals, so a request id that many operations share
    costs a sort and not all pairs.
    """
    requests = _identified(t, "provider-request", "request_slice_id")
    responses = _identified(t, "assistant-message", "message_slice_id")
    keys, blocks = ["capture_id", "request_id"], t.blocks("capture_id")
    return (
        count_overlaps(requests, responses, keys, blocks=blocks).withColumn("kind", F.lit("provider-request"))
        .unionByName(count_overlaps(responses, requests, keys, blocks=blocks).withColumn("kind", F.lit("assistant-message")))
    ).filter("overlaps > 0").select("id", "kind", "overlaps", "only_id")


@view()
def linked_requests(t: AgentTrace) -> DataFrame:
    """Requests already represented by their response: linked by a flow, or the
    one request that overlaps the one response it overlaps."""
    lone = t["request_match_counts"].filter("overlaps = 1")
    requests = lone.filter("kind = 'provider-request'").selectExpr("id", "only_id")
    responses = lone.filter("kind = 'assistant-message'").selectExpr("id as only_id")
    mutual = requests.join(responses, "only_id", "left_semi").select("id")
    return t["explicit_requests"].selectExpr("request_slice_id as id").unionByName(mutual).distinct()


@view(keep=True)
def turn_events(t: AgentTrace) -> DataFrame:
    """Operations with their owner; requests shown by their response are left out."""
    return (
        t["turn_work"].join(t["linked_requests"], "id", "left_anti").join(t["turn_owners"], "id", "left")
        .withColumn("observed_end_ts", F.expr("start_ts + greatest(coalesce(measured_ns, 0L), 0L)"))
    )


@view(keep=True)
def turn_bounds(t: AgentTrace) -> DataFrame:
    """Turns with displayed end, counts, unknowns, usage and model identities."""
    unknown = "(measured_ns is null or incomplete)"
    pair = "struct(nullif(trim(provider), '') as provider, nullif(trim(model), '') as model)"
    per_turn = t["turn_events"].filter("prompt_id is not null").groupBy("prompt_id").agg(
        F.expr("count(*) as events"),
        F.expr("max(observed_end_ts) as last_seen"),
        F.expr("count_if(kind = 'assistant-message') as model_calls"),
        F.expr("count_if(kind = 'provider-request') as unmatched_requests"),
        F.expr("count_if(kind = 'tool-execution') as tools"),
        F.expr(f"count_if(kind = 'assistant-message' and {unknown}) as unknown_models"),
        F.expr(f"count_if(kind = 'tool-execution' and {unknown}) as unknown_tools"),
        F.expr("sum(input_tokens) as input_tokens"),
        F.expr("sum(output_tokens) as output_tokens"),
        F.expr(f"array_sort(collect_set({pair}) filter (where kind = 'assistant-message')) as identities"),
    )
    shown = "greatest(start_ts, least(attribution_end_ts, coalesce(last_seen, start_ts)))"
    return t["turn_prompts"].join(per_turn, "prompt_id", "left").selectExpr(
        *[c for c in t["turn_prompts"].columns],
        f"if(incomplete, {shown}, recorded_end_ts) as display_end_ts",
        "coalesce(events, 0L) as events", "model_calls", "unmatched_requests", "tools", "unknown_models", "unknown_tools",
        "input_tokens", "output_tokens",
        "to_json(coalesce(identities, array()), map('ignoreNullFields', 'false')) as model_identities",
    )


@view()
def turn_activity(t: AgentTrace) -> DataFrame:
    """Exclusive and overlapping model and tool time inside each turn."""
    bounds = t["turn_bounds"].selectExpr("prompt_id", "capture_id", "start_ts as b0", "display_end_ts as b1")
    spans = (
        t["turn_events"].filter("kind in ('assistant-message', 'tool-execution') and measured_ns > 0 and not incomplete")
        .select("prompt_id", "start_ts", "observed_end_ts", "kind")
        .join(bounds, "prompt_id")
        .selectExpr(
            "capture_id", "prompt_id", "greatest(b0, start_ts) as ts", "least(b1, observed_end_ts) as end_ts",
            "if(kind = 'assistant-message', 1, 0) as models", "if(kind = 'tool-execution', 1, 0) as tools",
        )
        .filter("end_ts > ts")
    )
    swept = interval_sweep(spans, ["capture_id", "prompt_id"], ["models", "tools"], blocks=t.blocks("capture_id"))
    return swept.filter("dur > 0").groupBy("prompt_id").agg(
        F.expr("sum(if(models > 0 and tools = 0, dur, 0L)) as models_only_ns"),
        F.expr("sum(if(tools > 0 and models = 0, dur, 0L)) as tools_only_ns"),
        F.expr("sum(if(models > 0 and tools > 0, dur, 0L)) as overlap_ns"),
    )


@view()
def turns(t: AgentTrace) -> DataFrame:
    """Turns with how their time was used; the rest stays unattributed."""
    parts = ("models_only_ns", "tools_only_ns", "overlap_ns")
    rows = t["turn_bounds"].join(t["turn_activity"], "prompt_id", "left").na.fill(0, list(parts))
    # an open turn without a capture end has no known extent
    rest = "display_end_ts - start_ts - " + " - ".join(parts)
    return rows.withColumn(
        "unattributed_ns", F.expr(f"if(display_end_ts is null, null, greatest(0L, {rest}))")
    )


@view()
def turns_with_prompts(t: AgentTrace) -> DataFrame:
    """Turns with the text of their prompt."""
    text = t.tables["slice"].selectExpr("id as prompt_id", "attrs.text as prompt_text")
    return t["turns"].join(text, "prompt_id", "left")


@view()
def turn_unassigned(t: AgentTrace) -> DataFrame:
    return t["turn_events"].filter("prompt_id is null").groupBy("capture_id", "kind").agg(
        F.expr("count(*) as unassigned_events"), F.expr("count_if(incomplete or measured_ns is null) as unknown_or_incomplete")
    )


@view()
def turn_unassigned_totals(t: AgentTrace) -> DataFrame:
    return t["turn_events"].filter("prompt_id is null").agg(
        F.expr("count(*) as events"),
        F.expr("if(count(*) = 0, null, count_if(kind = 'assistant-message')) as responses"),
        F.expr("if(count(*) = 0, null, count_if(kind = 'tool-execution')) as tools"),
    )


@view()
def turn_operations(t: AgentTrace) -> DataFrame:
    """The operations of all turns with tool details, the turn of a launched
    child session, and the nesting depth inside the turn.

    Every side is keyed by the turn, so a filter on ``prompt_id`` reaches all scans.
    The sides hold a row for each operation, whatever the planner makes of their few
    columns; none of them is collected on the driver for a broadcast.
    """
    owned = t["turn_events"].filter("prompt_id is not null")
    keyed = owned.select("id", "prompt_id").hint("merge")
    total = owned.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("total_events"))
    details = t["tool_call_details"].select(
        "id", "intent", "arguments", "args_truncated", "language", "line_count", "call_id", "parent_call_id", "is_error"
    )
    first = t["messages"].selectExpr("id", "first_ns / 1e6D as first_content_ms")
    # a session recorded in several captures names no single child turn
    child = t["turn_prompts"].groupBy(F.col("session").alias("child_session")).agg(
        F.min("prompt_id").alias("child_prompt_id"), F.countDistinct("capture_id").alias("n")
    ).filter("n = 1").drop("n")
    depth = (
        t["script_children"].join(keyed.withColumnRenamed("id", "script_id"), "script_id")
        .groupBy("id", "prompt_id").agg(F.count(F.lit(1)).alias("depth"))
    )
    return (
        owned.join(total.hint("merge"), "prompt_id")
        .join(t["slices"].select("id", "name").join(keyed, "id").hint("merge"), ["id", "prompt_id"])
        .join(details.join(keyed, "id").hint("merge"), ["id", "prompt_id"], "left")
        .join(first.join(keyed, "id").hint("merge"), ["id", "prompt_id"], "left")
        .join(child, "child_session", "left")
        .join(depth.hint("merge"), ["id", "prompt_id"], "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0).cast("bigint")))
    )


def turn_waterfall(t: AgentTrace, prompt_id: int, max_rows: int | None = None) -> DataFrame:
    """The operations of one turn in order, all unless ``max_rows`` is given."""
    found = t["turn_operations"].filter(F.col("prompt_id") == prompt_id).orderBy("start_ts", "id")
    return found if max_rows is None else found.limit(max_rows)


def register_functions(t: AgentTrace, prefix: str = "") -> None:
    """SQL table functions over the trace: ``turn_waterfall(prompt_id)``.

    ``SELECT * FROM turn_waterfall(17) ORDER BY start_ts, id``, or beside another
    table with ``JOIN LATERAL turn_waterfall(p.prompt_id)``.
    """
    t.register(prefix, ("turn_operations",))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t["turn_operations"].schema)
    names = ", ".join(t["turn_operations"].columns)
    t.spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}turn_waterfall(target_prompt_id BIGINT) RETURNS TABLE({columns}) "
        f"RETURN SELECT {names} FROM {prefix}turn_operations WHERE prompt_id = target_prompt_id"
    )


def turns_page(t: AgentTrace, page: int = 0, size: int = 200) -> DataFrame:
    """One page of turns in time order, with the total count."""
    numbered = running(
        t["turns"], [], ["start_ts", "prompt_id"], {"position": Run("row_number")}, t.blocks("")
    )
    total = t["turn_prompts"].agg(F.count(F.lit(1)).alias("total_turns"))
    return numbered.filter(f"position > {page * size} and position <= {(page + 1) * size}").crossJoin(F.broadcast(total))


def slowest_turns(t: AgentTrace, limit: int = 20) -> DataFrame:
    """The turns with the longest extent."""
    return (
        t["turns"]
        .selectExpr(
            "prompt_id", "capture_id", "session", "turn_number", "incomplete", "start_ts",
            "display_end_ts - start_ts as extent_ns", "(display_end_ts - start_ts) / 1e6D as observed_extent_ms",
            *[f"{c}_ns / 1e6D as {c}_ms" for c in ("models_only", "tools_only", "overlap", "unattributed")],
            "events", "model_calls", "unmatched_requests", "tools", "unknown_models", "unknown_tools",
        )
        .orderBy(F.desc_nulls_last("extent_ns"), "prompt_id")
        .limit(limit)
        .drop("extent_ns")
    )
