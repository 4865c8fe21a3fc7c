"""Runtime resources of the recorded processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom import schema
from spanloom.operators.blocks import Run, running
from spanloom.operators.intervals import asof_last
from spanloom.plans.trace import AgentTrace, view
from spanloom.session import cut_lineage

_UNIT = "if(name = 'runtime.cpu', 'us consumed since previous sample', 'bytes')"


def _runtime_tracks(t: AgentTrace) -> DataFrame:
    return t["counter_tracks"].filter(F.col("name").isin(list(schema.RUNTIME_METRICS))).withColumnRenamed("id", "track_id")


@view()
def runtime_summary(t: AgentTrace) -> DataFrame:
    """Per track: samples, extremes and summed CPU.  A gauge's zero only closes
    the recording; CPU samples are amounts, so their zeros count."""
    rows = t.tables["counter"].join(_runtime_tracks(t), "track_id")
    real = "name = 'runtime.cpu' or value > 0"
    return rows.groupBy("capture_id", "track_id", "display_name", "name").agg(
        F.expr("count(*) as samples"),
        F.expr("min(ts) as first_sample_ts"),
        F.expr("max(ts) as last_sample_ts"),
        F.expr(f"min(value) filter (where {real}) as minimum"),
        F.expr(f"max(value) filter (where {real}) as maximum"),
        F.expr("sum(value) as total"),
    ).selectExpr(
        "capture_id", "track_id", "display_name as metric", f"{_UNIT} as unit", "samples", "first_sample_ts",
        "last_sample_ts", "minimum", "maximum", "if(name = 'runtime.cpu', total, null) as sampled_cpu_us",
    )


@view()
def runtime_samples(t: AgentTrace) -> DataFrame:
    return t.tables["counter"].join(_runtime_tracks(t), "track_id").selectExpr(
        "capture_id", "track_id", "ts", "display_name as metric", "value", f"{_UNIT} as unit"
    )


@view()
def cpu_sample_intervals(t: AgentTrace) -> DataFrame:
    """The interval each CPU sample describes: since the previous sample."""
    samples = t.tables["counter"].join(_runtime_tracks(t).filter("name = 'runtime.cpu'"), "track_id").select(
        "capture_id", "track_id", "ts", "value"
    )
    steps = running(
        samples, ["capture_id", "track_id"], ["ts"], {"start_ts": Run("lag", F.col("ts"))}, t.blocks("capture_id")
    )
    return steps.filter("start_ts is not null").selectExpr("capture_id", "track_id", "start_ts", "ts as end_ts", "value as cpu_us")


@view()
def phase_cpu(t: AgentTrace) -> DataFrame:
    """CPU time of the recorded process inside each measured tool, model or script phase: ``cpu_ns`` and the ``covered_ns`` of samples.

    A sample spreads evenly over the time since the one before it.  CPU time up to
    a point is then a running total with a straight line to the next sample, read
    once at the start and once at the end of a phase; the difference is what lies
    inside, so no phase meets the samples it spans.  Values are whole nanoseconds,
    rounded down at both ends.  A process-wide sample names no cause: phases that
    run at the same time each get all of it.
    """
    samples = t.tables["counter"].join(_runtime_tracks(t).filter("name = 'runtime.cpu'"), "track_id").selectExpr(
        "capture_id", "track_id", "ts", "cast(value * 1000 as bigint) as cpu"
    )
    blocks = t.blocks("capture_id")
    runs = {"_cpu": Run("sum", F.col("cpu")), "_next": Run("lead", F.struct("ts", "cpu")), "_before": Run("lag", F.col("ts"))}
    # written once: its tracks meet the phases, its rows the points
    steps = cut_lineage(running(samples, ["capture_id", "track_id"], ["ts"], runs, blocks).drop("cpu"))
    first = steps.filter("_before is null")
    phases = t["turn_work"].filter("measured_ns > 0").selectExpr("id as phase_id", "capture_id", "kind", "start_ts", "start_ts + measured_ns as end_ts")
    points = phases.join(first.select("capture_id", "track_id"), "capture_id").selectExpr(
        "phase_id", "capture_id", "track_id", "kind", "inline(array(struct(0 as side, start_ts as at), struct(1 as side, end_ts as at)))"
    ).withColumn("id", F.expr("phase_id * 2 + side"))
    # what comes before the first sample reads that one, offered ahead of all: a null sorts first
    ahead = {"from": F.lit(None).cast("long"), "tie": F.lit(None).cast("long"), "_next": F.lit(None).cast(steps.schema["_next"].dataType)}
    offers = steps.withColumns({"from": F.col("ts"), "tie": F.expr("coalesce(ts, 0L)")}).unionByName(first.withColumns(ahead))
    read = asof_last(
        points, offers, ["capture_id", "track_id"], left_ts="at", right_ts="from", right_tie="tie",
        value=F.struct("ts", "_cpu", "_next"), out="s", blocks=blocks,
    )
    part = "cast(cast(at - s.ts as decimal(38,0)) * s._next.cpu div (s._next.ts - s.ts) as bigint)"
    placed = read.selectExpr(
        "*", f"if(s._next is null, s._cpu, s._cpu + {part}) as total", "if(s._next is null, s.ts, at) as seen"
    )
    return placed.groupBy("phase_id", "capture_id", "track_id", "kind").agg(
        F.expr("max(total) filter (where side = 1) - max(total) filter (where side = 0) as cpu_ns"),
        F.expr("max(seen) filter (where side = 1) - max(seen) filter (where side = 0) as covered_ns"),
    ).withColumnRenamed("phase_id", "id")
