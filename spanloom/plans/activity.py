"""Where the time went: occupancy, concurrency and activity profiles.

All measures are unions over the classes ``models``, ``tools`` and ``scripts``
(scripts and scripted model calls), so overlapping work is counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.attributes import is_configuration_name, is_metadata_category, total_sql
from spanloom.operators.intervals import bin_edge, integer_div, interval_sweep
from spanloom.plans.captures import clock_errors
from spanloom.plans.models import MEASURED, RATED
from spanloom.plans.trace import AgentTrace, view

CLASSES = ["models", "tools", "scripts"]
CONCURRENCY_BINS = 40
SESSION_BINS = 48


def work_intervals(t: AgentTrace) -> DataFrame:
    """Completed measured work as ``capture_id, ts, end_ts, models, tools, scripts``.

    One pass over the slices: a message is placed by its recorded duration when
    it is an instant, everything else by its own bounds.
    """
    rows = t["slices"].filter(
        "not incomplete and kind in ('assistant-message', 'tool-execution', 'script', 'model-call')"
    )
    # a message without a positive span uses its recorded duration, back from its end
    span = "if(kind = 'assistant-message' and dur <= 0, attrs.duration_ns, dur)"
    start = "if(kind = 'assistant-message' and dur <= 0, ts - attrs.duration_ns, ts)"
    return rows.selectExpr("capture_id", f"{start} as ts", f"{span} as span", "kind").filter("span > 0").selectExpr(
        "capture_id",
        "ts",
        "ts + span as end_ts",
        "if(kind = 'assistant-message', 1, 0) as models",
        "if(kind = 'tool-execution', 1, 0) as tools",
        "if(kind in ('script', 'model-call'), 1, 0) as scripts",
    )


@view(keep=True)
def activity(t: AgentTrace) -> DataFrame:
    """Segments of the whole recording with the concurrency of each class.

    One global order: beyond the block size it is cut into ranges of time, so
    it is no single-task window.
    """
    return interval_sweep(work_intervals(t), [], CLASSES, blocks=t.blocks(""))


@view()
def recording_summary(t: AgentTrace) -> DataFrame:
    """One row of counts over the whole recording."""
    counts = t["slices"].agg(
        F.expr("count_if(kind = 'prompt') as turns"),
        F.expr("count_if(kind = 'assistant-message') as responses"),
        F.expr("count_if(kind = 'script') as scripts"),
        F.expr("count_if(kind = 'tool-execution') as tools"),
        F.expr("count_if(incomplete) as incomplete"),
        F.expr("coalesce(sum(attrs.unavailable_child_sessions) filter (where kind = 'capture'), 0L) as unavailable_children"),
        F.expr("(max(ts + greatest(dur, 0L)) - min(ts)) / 1e6D as duration_ms"),
    )
    hierarchy = t["capture_hierarchy"].agg(
        F.expr("count(distinct root_capture_id) as sessions"), F.expr("count_if(capture_id != root_capture_id) as subagents")
    )
    described = (F.col("kind") == "assistant-message") | (
        is_metadata_category(F.col("category"), t.vendor) & is_configuration_name(F.col("name"))
    )
    # distinct(), because countDistinct would skip pairs with a null
    single = (
        t["slices"].filter(described).selectExpr("attrs.provider as provider", "attrs.model as model").distinct().agg(
            F.expr("count(*) = 1 and bool_and(coalesce(model, '') != '') as single_model")
        )
    )
    seen = t["slices"].select("capture_id").distinct()
    machines = (
        t.tables["track"]
        .selectExpr("id as track_id", "coalesce(machine_id, 0L) as machine_id")
        .join(t["track_process"].hint("merge"), "track_id")
        .join(seen.hint("merge"), "capture_id", "left_semi")
        .agg(F.countDistinct("machine_id").alias("machines"))
    )
    out = hierarchy
    for one_row in (single, counts, machines, clock_errors(t)):
        out = out.crossJoin(F.broadcast(one_row))  # global aggregates: one row each
    return out


@view()
def recording_headline(t: AgentTrace) -> DataFrame:
    rate = t["messages"].agg(
        F.expr(
            f"sum(output_tokens) filter (where {RATED}) * 1e9D / {total_sql('message_ns', RATED)}"
            " as output_tokens_per_s"
        )
    )
    busy = t["activity"].agg(
        F.expr("sum(dur) filter (where dur > 0 and models > 0) / 1e6D as model_busy_ms"),
        F.expr("max(models) filter (where dur > 0 and models > 0) as peak_model_responses"),
    )
    wall = t["slices"].agg(F.expr("(max(ts + greatest(dur, 0L)) - min(ts)) / 1e6D as wall_window_ms"))
    return rate.crossJoin(F.broadcast(busy)).crossJoin(F.broadcast(wall))  # one row each


def _held(condition: str) -> str:
    return f"sum(if({condition}, dur, 0L))"


@view()
def activity_summary(t: AgentTrace) -> DataFrame:
    """How the recording's time splits between tools, models and scripts."""
    return t["activity"].filter("dur > 0").agg(
        F.expr(f"{_held('tools > 0 and models = 0')} / 1e6D as tools_only_ms"),
        F.expr(f"{_held('models > 0 and tools = 0')} / 1e6D as models_only_ms"),
        F.expr(f"{_held('models > 0 and tools > 0')} / 1e6D as overlap_ms"),
        F.expr(f"{_held('scripts > 0 and tools = 0 and models = 0')} / 1e6D as scripts_only_ms"),
        F.expr("max(tools) as peak_tools"),
        F.expr(f"{_held('tools > 1')} / 1e6D as parallel_ms"),
        F.expr(f"{_held('tools > 0')} / 1e6D as tool_active_ms"),
    )


def _spread(segments: DataFrame, bins: int) -> DataFrame:
    """One row per segment and bin it meets, with the bin's integer edges.

    ``segments`` has ``ts, end_ts, start_ts, extent``.  Segments of a key do
    not overlap, so this adds at most ``bins`` rows per key.
    """
    extent, start = F.col("extent"), F.col("start_ts")

    def at(ts: Column) -> Column:
        return integer_div((ts - start) * bins, extent)

    # integer edges are floored, so a point may lie one bin right of its ratio
    first = F.greatest(F.lit(0), at(F.col("ts")))
    last = F.least(F.lit(bins - 1), at(F.col("end_ts")) + 1)
    met = segments.filter("extent > 0").withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
    return met.withColumns(
        {"bin_ts": bin_edge(start, extent, F.col("bin"), bins), "bin_end": bin_edge(start, extent, F.col("bin") + 1, bins)}
    ).filter("ts < bin_end and end_ts > bin_ts")


@view()
def tool_concurrency_bins(t: AgentTrace) -> DataFrame:
    """Peak of concurrent tools in 40 equal windows of the measured time."""
    measured = t["activity"].filter("dur > 0").selectExpr("ts", "ts + dur as end_ts", "tools")
    bounds = measured.agg(F.expr("min(ts) as start_ts"), F.expr("max(end_ts) - min(ts) as extent"))
    one = F.broadcast(bounds)  # one row
    peaks = _spread(measured.crossJoin(one), CONCURRENCY_BINS).groupBy("bin").agg(F.max("tools").alias("tools"))
    grid = t.spark.range(CONCURRENCY_BINS).withColumnRenamed("id", "bin").crossJoin(one).filter("start_ts is not null")
    offset = bin_edge(F.col("start_ts"), F.col("extent"), F.col("bin"), CONCURRENCY_BINS) - F.col("start_ts")
    return grid.join(F.broadcast(peaks), "bin", "left").select(  # at most 40 rows
        F.col("bin").alias("n"),
        (offset / F.lit(1e6)).alias("offset_ms"),
        F.coalesce("tools", F.lit(0)).cast("bigint").alias("tools"),
    )


@view()
def capture_occupancy(t: AgentTrace) -> DataFrame:
    """Per capture: exclusive and overlapping time of each class, the gap no
    class explains, tool parallelism, counter peaks and coverage."""
    intervals = work_intervals(t)
    segments = interval_sweep(intervals, ["capture_id"], CLASSES, blocks=t.blocks("capture_id"))
    # the swept boundaries are the interval bounds, so the extent comes along
    totals = segments.groupBy("capture_id").agg(
        F.expr("min(ts) as work_start"),
        F.expr("max(ts) as work_end"),
        F.expr(f"{_held('dur > 0 and models > 0 and tools = 0')} as model_only_ns"),
        F.expr(f"{_held('dur > 0 and tools > 0 and models = 0')} as tool_only_ns"),
        F.expr(f"{_held('dur > 0 and models > 0 and tools > 0')} as overlap_ns"),
        F.expr(f"{_held('dur > 0 and scripts > 0 and models = 0 and tools = 0')} as script_only_ns"),
        F.expr(f"{_held('dur > 0 and tools > 1')} as parallel_tool_ns"),
        F.expr("max(if(dur > 0, tools, null)) as peak_tools"),
    )
    extents = t["capture_runs"].groupBy("capture_id").agg(F.min("start_ts").alias("run_start"), F.max("end_ts").alias("run_end"))
    samples = t["messages"].groupBy("capture_id").agg(
        F.expr(f"count_if({MEASURED}) as measured_responses"), F.expr("count(output_tokens) as output_usage_samples")
    )
    rows = (
        t["capture_runs"]
        .join(extents, "capture_id")
        .join(totals, "capture_id", "left")
        .join(samples, "capture_id", "left")
        .withColumn("extent", F.expr("greatest(run_end, work_end) - least(run_start, work_start)"))
        .na.fill(0, ["model_only_ns", "tool_only_ns", "overlap_ns", "script_only_ns", "parallel_tool_ns", "peak_tools"])
    )
    parts = ("model_only", "tool_only", "overlap", "script_only")
    return rows.selectExpr(
        "capture_id", "session", "harness", "provider", "model", "effort", "turns as prompts", "responses", "tools",
        "incomplete", "extent / 1e6D as observed_extent_ms",
        *[f"{p}_ns / 1e6D as {p}_ms" for p in parts],
        "greatest(0L, extent - " + " - ".join(f"{p}_ns" for p in parts) + ") / 1e6D as unattributed_ms",
        "parallel_tool_ns / 1e6D as parallel_tool_ms", "peak_tools",
        "input_tokens as reported_input_counter_peak", "output_tokens as reported_output_counter_peak",
        "peak_context", "context_window_tokens", "context_share",
        "coalesce(measured_responses, 0L) as measured_responses",
        "coalesce(output_usage_samples, 0L) as output_usage_samples",
    )


def _busy_bins(t: AgentTrace, bounds: DataFrame, intervals: DataFrame, blocks) -> DataFrame:
    """Busy share of each of 48 bins between a key's bounds; null when the key
    has no measured work or the bin is empty."""
    spans = intervals.selectExpr("capture_id", "ts", "end_ts", "1 as active")
    segments = interval_sweep(spans, ["capture_id"], ["active"], blocks=blocks)
    measured = segments.select("capture_id").distinct().withColumn("is_measured", F.lit(True))
    edges = bounds.withColumn("extent", F.expr("end_ts - start_ts")).drop("end_ts")
    busy = segments.filter("active > 0 and dur > 0").selectExpr("capture_id", "ts", "ts + dur as end_ts").join(
        edges, "capture_id"
    )
    filled = _spread(busy, SESSION_BINS).groupBy("capture_id", "bin").agg(
        F.expr("sum(least(end_ts, bin_end) - greatest(ts, bin_ts)) as busy_ns")
    )
    grid = edges.join(measured, "capture_id", "left").withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SESSION_BINS - 1).cast("bigint")))
    )
    width = bin_edge(F.col("start_ts"), F.col("extent"), F.col("bin") + 1, SESSION_BINS) - bin_edge(
        F.col("start_ts"), F.col("extent"), F.col("bin"), SESSION_BINS
    )
    share = F.when(
        F.col("is_measured") & (width > 0),
        F.least(F.lit(1.0), F.coalesce("busy_ns", F.lit(0)).cast("double") / width.cast("double")),
    )
    return grid.join(filled, ["capture_id", "bin"], "left").select("capture_id", "bin", share.alias("busy_fraction"))


@view()
def capture_activity_bins(t: AgentTrace) -> DataFrame:
    """Activity profile of each capture."""
    bounds = t["capture_runs"].groupBy("capture_id").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return _busy_bins(t, bounds, work_intervals(t), t.blocks("capture_id"))


@view()
def session_activity_bins(t: AgentTrace) -> DataFrame:
    """Activity profile of each root session with its subagents."""
    h = t["capture_hierarchy"].select("capture_id", "root_capture_id")

    def at_root(df: DataFrame) -> DataFrame:
        return df.join(h, "capture_id").drop("capture_id").withColumnRenamed("root_capture_id", "capture_id")

    bounds = at_root(t["capture_runs"].select("capture_id", "start_ts", "end_ts")).groupBy("capture_id").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")
    )
    return _busy_bins(t, bounds, at_root(work_intervals(t)), t.blocks("root_capture_id").renamed("capture_id"))
