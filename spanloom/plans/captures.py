"""Captures: finding them, normalising their slices, and summarising each.

A capture is one recording of one agent session.  Frames here add the capture,
session, kind and completeness to every agent slice; all other modules read
``slices`` and ``capture_runs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom import schema
from spanloom.functions.attributes import (
    attr,
    is_agent_category,
    is_configuration_name,
    is_marker_name,
    is_metadata_category,
    kind_of,
)
from spanloom.operators.trees import nearest_ancestor, path_totals
from spanloom.plans.trace import AgentTrace, view

_END = "ts + greatest(dur, 0L)"


def _null_if_empty(column: str):
    return F.expr(f"nullif(array_join(array_sort(collect_set({column})), ','), '')")


@view()
def detected(t: AgentTrace) -> DataFrame:
    """How many slices follow a supported recording schema."""
    supported = F.col("category").startswith("pi.") | (
        F.col("category").isin([f"{h}.metadata" for h in (*schema.HARNESSES[1:], t.vendor)])
        & (attr("kind") == "capture")
        & (attr("schema_version") == 1)
    )
    return t.tables["slice"].filter(supported).agg(F.count(F.lit(1)).alias("count"))


@view(keep=True)
def track_process(t: AgentTrace) -> DataFrame:
    """Process and capture of each track, from the track and all its ancestors."""
    by_process = t.tables["process_track"].selectExpr("id", "upid as p1")
    by_counter = t.tables["process_counter_track"].selectExpr("id", "upid as p2")
    by_thread = (
        t.tables["thread_track"].join(t.tables["thread"].select("utid", "upid"), "utid").selectExpr("id", "upid as p3")
    )
    own = (
        t.tables["track"]
        .join(by_process, "id", "left")
        .join(by_counter, "id", "left")
        .join(by_thread, "id", "left")
    )
    totals = path_totals(
        own,
        {"upid": F.expr("coalesce(p1, p2, p3)"), "root": F.expr(f"if(name = '{t.vendor}.capture', id, null)")},
    )
    return totals.selectExpr("id as track_id", "upid", "coalesce(root, -1 - upid, -1 - id) as capture_id")


@view(keep=True)
def counter_tracks(t: AgentTrace) -> DataFrame:
    """Counter tracks under their canonical metric name, whatever the spelling."""
    spellings = [
        (alias, metric, display, group)
        for metric, display, group in schema.COUNTERS
        for alias in sorted(
            {metric, display, f"Context: {display}", *schema.COUNTER_ALIASES.get(metric, ())}
        )
    ]
    # a fixed list of some seventy spellings
    names = t.spark.createDataFrame(spellings, "recorded string, name string, display_name string, group_name string")
    return (
        t.tables["counter_track"]
        .withColumnRenamed("name", "recorded")
        .join(F.broadcast(names), "recorded")
        .join(t["track_process"].withColumnRenamed("track_id", "id"), "id")
        .select("id", "name", "display_name", "group_name", "capture_id")
    )


@view(keep=True)
def capture_markers(t: AgentTrace) -> DataFrame:
    """Slices that announce a capture, resolved to its root track by trace id."""
    marks = (
        t.tables["slice"]
        .filter(is_metadata_category(F.col("category"), t.vendor) & is_marker_name(F.col("name")))
        .selectExpr(
            "id as slice_id", "track_id", "attrs.capture_id as recorded_id", "attrs.session_id as session_id",
            "attrs.label as label", "attrs.peak_context_tokens as peak_context_tokens",
        )
    )
    root = (
        t.tables["track"]
        .filter((F.col("name") == f"{t.vendor}.capture") & F.col("trace_id").isNotNull())
        .selectExpr("id as root_id", "lower(hex(trace_id)) as recorded_id")
    )
    return (
        marks.join(t["track_process"].select("track_id", "capture_id").hint("merge"), "track_id")
        .join(root, "recorded_id", "left")
        .selectExpr(
            "slice_id", "coalesce(root_id, capture_id) as capture_id", "recorded_id", "session_id", "label",
            "track_id", "peak_context_tokens",
        )
    )


@view()
def captures(t: AgentTrace) -> DataFrame:
    """One row of identity per capture."""
    return t["capture_markers"].groupBy("capture_id").agg(
        *[F.max(c).alias(c) for c in ("recorded_id", "session_id", "label")],
        F.max("peak_context_tokens").alias("marker_peak_context"),
    )


@view(keep=True)
def slice_capture(t: AgentTrace) -> DataFrame:
    """Agent slices below a capture marker: the nearest enclosing one owns them.

    Only tracks that hold a marker are walked.
    """
    marks = t["capture_markers"].selectExpr("slice_id as id", "capture_id as marked")
    tracks = t["capture_markers"].select("track_id").distinct()
    walked = t.tables["slice"].select("id", "parent_id", "track_id", "category").join(tracks, "track_id", "left_semi")
    nodes = walked.join(marks, "id", "left")
    found = nearest_ancestor(nodes, is_stop=F.col("marked").isNotNull())
    return (
        found.join(marks.selectExpr("id as ancestor_id", "marked as capture_id"), "ancestor_id")
        .join(nodes.filter(is_agent_category(F.col("category"), t.vendor)).select("id"), "id", "left_semi")
        .select("id", "capture_id")
    )


@view(keep=True)
def slices(t: AgentTrace) -> DataFrame:
    """Agent slices with capture, session, kind and completeness."""
    track = t.tables["track"].selectExpr("id as track_id", "name as recorded_track")
    thread = t.tables["thread_track"].join(t.tables["thread"].drop("upid"), "utid", "left").selectExpr(
        "id as track_id", "utid", "name as thread_name", "tid"
    )
    process = t.tables["process"].selectExpr(
        "upid", "substring(filter(labels, l -> startswith(l, 'session:'))[0], 9) as process_session"
    )
    # a capture's identity is joined to the tracks and to the owned slices, so that the wide rows need no third join
    identity = t["captures"].select("capture_id", F.struct("label", "recorded_id", "session_id").alias("identity"))
    lanes = (
        track.join(t["track_process"], "track_id", "left")
        .join(identity, "capture_id", "left")
        .withColumnsRenamed({"capture_id": "track_capture", "identity": "track_identity"})
        .join(thread, "track_id", "left")
        .join(process, "upid", "left")
    )
    owned = t["slice_capture"].join(identity, "capture_id", "left").withColumnsRenamed(
        {"capture_id": "own_capture", "identity": "own_identity"}
    )
    kinds = (
        t.tables["slice"]
        .filter(is_agent_category(F.col("category"), t.vendor))
        .join(lanes, "track_id")
        .join(owned, "id", "left")
        .withColumn("capture_id", F.expr("coalesce(own_capture, track_capture)"))
        .withColumn("identity", F.expr("if(own_capture is null, track_identity, own_identity)"))
    )
    unknown = "concat('process ', coalesce(cast(upid as string), 'unknown'))"
    return kinds.select(
        "id", "parent_id", "track_id", "ts", "dur", "name", "category", "attrs",
        F.expr("coalesce(recorded_track, concat(thread_name, ' ', tid), concat('Thread ', tid)) as track_name"),
        "upid", "utid", "capture_id",
        F.expr(f"coalesce(identity.label, substring(identity.recorded_id, 1, 8), '{schema.LEGACY_CAPTURE}') as capture"),
        F.expr(f"coalesce(identity.session_id, process_session, {unknown}) as session"),
        kind_of(F.col("recorded_track")).alias("kind"),
        F.expr(
            "dur < 0 or coalesce(attrs.incomplete, 0) != 0 or coalesce(attrs.provider_incomplete, 0) != 0 as incomplete"
        ),
    )


@view()
def configuration(t: AgentTrace) -> DataFrame:
    """Harness, provider, model, effort and window, as recorded over time."""
    rows = t["slices"].filter(is_metadata_category(F.col("category"), t.vendor) & is_configuration_name(F.col("name")))
    recorded = [F.coalesce(attr(c), F.lit(schema.NOT_RECORDED)).alias(c) for c in ("harness", "provider", "model", "effort")]
    return rows.select(
        "id", "capture_id", *recorded, attr("context_window_tokens").alias("context_window_tokens"),
        attr("session_labels").alias("session_labels"),
    )


@view()
def session_labels(t: AgentTrace) -> DataFrame:
    """Distinct non-blank labels of each capture as a sorted JSON array."""
    labels = t["configuration"].selectExpr("capture_id", "explode(session_labels) as label").selectExpr(
        "capture_id", "trim(label) as label"
    )
    return (
        labels.filter("label != ''").groupBy("capture_id").agg(F.expr("to_json(array_sort(collect_set(label))) as session_labels"))
    )


@view(keep=True)
def counter_totals(t: AgentTrace) -> DataFrame:
    """Per capture the maxima of its counters.

    A track's total is its maximum, because a closing zero ends it; tracks of a
    capture then add up.
    """
    names = [
        "llm.tokens.input", "llm.tokens.output", "llm.context.estimated_tokens",
        "tracing.droppedEvents", "tracing.laneOverflows", "tracing.queueDepth",
    ]
    # collapse the samples to one row per track before any join
    per_track = t.tables["counter"].groupBy("track_id").agg(F.max("value").alias("maximum"))
    wanted = t["counter_tracks"].filter(F.col("name").isin(names)).selectExpr("id as track_id", "capture_id", "name")

    def total(how: str, name: str, out: str):
        return F.expr(f"{how}(maximum) filter (where name = '{name}') as {out}")

    return per_track.join(wanted, "track_id").groupBy("capture_id").agg(
        total("sum", "llm.tokens.input", "input_tokens"),
        total("sum", "llm.tokens.output", "output_tokens"),
        total("max", "llm.context.estimated_tokens", "counter_peak_context"),
        total("max", "tracing.droppedEvents", "dropped_events"),
        total("max", "tracing.laneOverflows", "lane_overflows"),
        total("max", "tracing.queueDepth", "queue_depth_peak"),
    )


@view(keep=True)
def capture_runs(t: AgentTrace) -> DataFrame:
    """Summary of each capture and session: bounds, counts, configuration, totals."""
    runs = t["slices"].groupBy("capture_id", "session").agg(
        F.expr("min(ts) as start_ts"),
        F.expr(f"max({_END}) as end_ts"),
        F.expr("count_if(kind = 'prompt') as turns"),
        F.expr("count_if(kind = 'assistant-message') as responses"),
        F.expr("count_if(kind = 'tool-execution') as tools"),
        F.expr("count_if(incomplete) as incomplete"),
    )
    config = t["configuration"].groupBy("capture_id").agg(
        *[_null_if_empty(c).alias(c) for c in ("harness", "provider", "model", "effort")],
        F.max("context_window_tokens").alias("context_window_tokens"),
        F.expr("count(distinct context_window_tokens) as context_window_count"),
    )
    joined = (
        runs.join(t["captures"].drop("session_id"), "capture_id", "left")
        .join(t["session_labels"], "capture_id", "left")
        .join(config, "capture_id", "left")
        .join(t["counter_totals"].select("capture_id", "input_tokens", "output_tokens", "counter_peak_context"), "capture_id", "left")
        .withColumn("peak_context", F.expr("coalesce(cast(marker_peak_context as double), counter_peak_context)"))
    )
    return joined.selectExpr(
        "capture_id", "session", "start_ts", "end_ts", "turns", "responses", "tools", "incomplete",
        "(end_ts - start_ts) / 1e6D as duration_ms",
        f"coalesce(label, substring(recorded_id, 1, 8), '{schema.LEGACY_CAPTURE}') as capture",
        "recorded_id", "harness", "provider", "model", "session_labels", "effort", "context_window_tokens",
        "input_tokens", "output_tokens", "peak_context",
        """case when context_window_count = 1 and context_window_tokens > 0
                then peak_context / context_window_tokens end as context_share""",
    )


@view()
def capture_health(t: AgentTrace) -> DataFrame:
    """Largest recorded value of each diagnostic counter track."""
    tracks = t["counter_tracks"].filter("name in ('tracing.droppedEvents', 'tracing.laneOverflows')")
    per_track = t.tables["counter"].groupBy("track_id").agg(F.max("value").alias("value"))
    return per_track.join(
        tracks.selectExpr("id as track_id", "capture_id", "name as metric_key", "display_name as metric"), "track_id"
    ).select("track_id", "capture_id", "metric_key", "metric", "value")


def clock_errors(t: AgentTrace) -> DataFrame:
    """One row: how many events the import could not place in time."""
    return t.tables["stats"].filter(F.col("name").isin(list(schema.CLOCK_ERRORS))).agg(
        F.expr("coalesce(sum(value), 0L) as clock_errors")
    )


@view()
def inventory(t: AgentTrace) -> DataFrame:
    """Coverage and health per capture, without payloads."""
    machine = t.tables["track"].selectExpr("id as track_id", "coalesce(machine_id, 0L) as machine_id")
    measured = "if(dur > 0, dur, attrs.duration_ns) >= 0"
    message = "kind = 'assistant-message'"
    by_track = t["slices"].groupBy("capture_id", "track_id").agg(
        F.expr(f"count_if({message} and not incomplete and {measured}) as measured_responses"),
        F.expr(f"count_if({message} and not incomplete and attrs.first_content_ns >= 0) as first_content_samples"),
        F.expr(f"count_if({message} and attrs.output_tokens is not null) as output_usage_samples"),
        F.expr("count_if(attrs.context.version = 1) as context_snapshots"),
        F.expr("sum(attrs.unavailable_child_sessions) filter (where kind = 'capture') as unavailable_children"),
    )
    counted = by_track.join(machine, "track_id").groupBy("capture_id").agg(
        *[
            F.sum(c).alias(c)
            for c in (
                "measured_responses", "first_content_samples", "output_usage_samples", "context_snapshots",
                "unavailable_children",
            )
        ],
        F.countDistinct("machine_id").alias("machines"),
    )
    runtime = t["counter_tracks"].filter(F.col("name").isin(list(schema.RUNTIME_METRICS))).groupBy("capture_id").agg(
        F.countDistinct("name").alias("runtime_metrics")
    )
    health = t["counter_totals"].select("capture_id", "dropped_events", "lane_overflows", "queue_depth_peak")
    rows = (
        t["capture_runs"]
        .join(counted, "capture_id")
        .join(runtime, "capture_id", "left")
        .join(health, "capture_id", "left")
        .crossJoin(F.broadcast(clock_errors(t)))  # one row
    )
    return rows.selectExpr(
        "capture_id", "session", "capture", "harness", "provider", "model", "effort", "context_window_tokens",
        "duration_ms as retained_extent_ms", "turns as prompts", "responses", "tools", "incomplete",
        "measured_responses", "first_content_samples", "output_usage_samples", "context_snapshots",
        "coalesce(runtime_metrics, 0L) as runtime_metrics", "dropped_events", "lane_overflows", "queue_depth_peak",
        "unavailable_children", "machines", "clock_errors as trace_clock_errors",
    )
