"""Comparing, reconciling and auditing recorded runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from spanloom.operators.blocks import Run, running
from spanloom.operators.intervals import interval_sweep, interval_union_length
from spanloom.operators.ranks import median_and_rank
from spanloom.plans.activity import work_intervals
from spanloom.plans.captures import clock_errors
from spanloom.plans.trace import AgentTrace


def compare_runs(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per case and variant: runs, how many were correct, conforming and valid,
    and median, minimum and maximum of each metric.  A metric nobody measured
    stays null.  ``runs`` has boolean ``correct, conformant, valid``."""
    counts = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.count_if(c).alias(c) for c in ("correct", "conformant", "valid")],
        *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("min", F.min), ("max", F.max))],
    )
    total = runs.count()
    for m in metrics:
        # few variants hold all runs, so the median must not gather a variant
        middle = median_and_rank(runs, keys, m, 50, rows=total).select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.col("median").alias(f"{m}_median")
        )
        same = [counts[k].eqNullSafe(middle[f"_{k}"]) for k in keys]
        counts = counts.join(middle, same, "left").drop(*[f"_{k}" for k in keys])
    return counts


def run_breakdown(t: AgentTrace) -> DataFrame:
    """Per capture: time in model exchange (responses and requests joined), in
    tools without and with overlap, in scripts, and not covered by any."""
    rows = t["slices"].filter("kind in ('assistant-message', 'provider-request', 'tool-execution', 'script', 'model-call')")
    span = "if(kind = 'assistant-message' and dur <= 0, attrs.duration_ns, dur)"
    start = "if(kind = 'assistant-message' and dur <= 0, ts - attrs.duration_ns, ts)"
    spans = rows.filter("not incomplete").selectExpr("capture_id", "kind", f"{start} as ts", f"{span} as span").filter("span >= 0")
    classed = spans.filter("span > 0").selectExpr(
        "capture_id", "ts", "ts + span as end_ts",
        "if(kind in ('assistant-message', 'provider-request'), 1, 0) as exchange",
        "if(kind in ('tool-execution', 'script', 'model-call'), 1, 0) as tools",
    )
    swept = interval_sweep(classed, ["capture_id"], ["exchange", "tools"], blocks=t.blocks("capture_id"))
    union = swept.groupBy("capture_id").agg(
        F.expr("sum(dur) filter (where exchange > 0) as exchange_ns"),
        F.expr("sum(dur) filter (where tools > 0) as tool_active_ns"),
        F.expr("sum(dur) filter (where exchange > 0 or tools > 0) as covered_ns"),
    )
    sums = spans.groupBy("capture_id").agg(
        F.expr("sum(span) filter (where kind = 'assistant-message') as response_ns"),
        F.expr("sum(span) filter (where kind = 'tool-execution') as tool_work_ns"),
        F.expr("sum(span) filter (where kind in ('script', 'model-call')) as script_ns"),
        F.expr("sum(span) filter (where kind = 'provider-request') as request_ns"),
        F.expr("min(struct(ts, span)) filter (where kind = 'provider-request') as first"),
    )
    return (
        t["capture_runs"].selectExpr("capture_id", "session", "end_ts - start_ts as wall_ns")
        .join(union, "capture_id", "left").join(sums, "capture_id", "left")
        .selectExpr(
            "capture_id", "session", "wall_ns",
            *[f"coalesce({c}, 0L) as {c}" for c in ("exchange_ns", "response_ns", "tool_work_ns", "script_ns", "tool_active_ns")],
            "request_ns", "first.span as first_request_ns", "greatest(0L, wall_ns - coalesce(covered_ns, 0L)) as uncovered_ns",
        )
    )


def scripted_tool_stats(t: AgentTrace) -> DataFrame:
    """Per capture: calls the model made itself, scripts, work they ran, nested
    calls, input with cache, and the context peak."""
    calls = t["tool_calls"].groupBy("capture_id").agg(
        F.expr("count_if(parent_call_id is null) as outer_calls"),
        F.expr("count_if(kind = 'script') as scripts"),
        F.expr("count_if(kind != 'script') as executed"),
        F.expr("count_if(parent_call_id is not null) as nested"),
    )
    usage = t["messages"].groupBy("capture_id").agg(
        F.expr("sum(coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0)) as total_input")
    )
    return t["capture_runs"].select("capture_id", "peak_context").join(calls, "capture_id", "left").join(
        usage, "capture_id", "left"
    ).selectExpr(
        "capture_id", *[f"coalesce({c}, 0L) as {c}" for c in ("outer_calls", "scripts", "executed", "nested")], "total_input", "peak_context"
    )


def reconcile_usage(t: AgentTrace, manifest: DataFrame) -> DataFrame:
    """Captures against what their manifest expects: ``capture_id`` and the
    expected ``input_tokens, output_tokens, responses, tools, scripts, nested``.
    Lists every disagreement, and nested calls without a script."""
    m = t["messages"].groupBy("capture_id").agg(
        F.expr("count(*) as got_responses"),
        F.expr("sum(coalesce(input_tokens, 0)) as got_input_tokens"),
        F.expr("sum(coalesce(output_tokens, 0)) as got_output_tokens"),
    )
    calls = t["tool_calls"]
    c = calls.groupBy("capture_id").agg(
        F.expr("count_if(kind = 'tool-execution') as got_tools"),
        F.expr("count_if(kind = 'script') as got_scripts"),
        F.expr("count_if(parent_call_id is not null) as got_nested"),
    )
    scripts = calls.filter("kind = 'script' and call_id is not null").selectExpr("capture_id", "call_id as parent_call_id").distinct()
    orphans = calls.filter("parent_call_id is not null").join(scripts, ["capture_id", "parent_call_id"], "left_anti").groupBy(
        "capture_id"
    ).agg(F.count(F.lit(1)).alias("orphans"))
    fields = ("input_tokens", "output_tokens", "responses", "tools", "scripts", "nested")
    rows = manifest.join(m, "capture_id", "left").join(c, "capture_id", "left").join(orphans, "capture_id", "left")
    issues = [f"if(coalesce(got_{f}, 0L) != {f}, '{f}', null)" for f in fields]
    issues.append("if(orphans > 0, 'nested call without script', null)")
    return rows.selectExpr("capture_id", f"array_join(array_compact(array({', '.join(issues)})), ',') as issues")


def baseline_delta(rows: DataFrame, baseline: DataFrame, metric: str) -> DataFrame:
    """``difference`` and ``percent`` of a metric against a one-row baseline;
    null when either side is unknown, and no percentage of a zero."""
    base = F.broadcast(baseline.select(F.col(metric).alias("_base")).limit(1))  # one row
    return rows.crossJoin(base).withColumns(
        {
            "difference": F.col(metric) - F.col("_base"),
            "percent": F.when(F.col("_base") != 0, (F.col(metric) - F.col("_base")) * 100.0 / F.abs("_base")),
        }
    ).drop("_base")


def context_pressure_delta(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Context compared as share when both windows are equal, else as peak tokens."""
    base = F.broadcast(
        baseline.selectExpr("context_window_tokens as w0", "context_share as s0", "peak_context as p0").limit(1)  # one row
    )
    same = "context_window_tokens = w0 and context_share is not null and s0 is not null"
    return rows.crossJoin(base).selectExpr(
        "capture_id", f"if({same}, 'share', 'peak') as basis", f"if({same}, context_share - s0, peak_context - p0) as difference"
    )


def failure_history_audit(failures: DataFrame) -> DataFrame:
    """How each owner's failures divide, from the runs before: all passed means
    new, all failed persistent, else intermittent.  ``failures``: ``id, owner,
    duration_ms, history array<boolean>`` (true: failed)."""
    return classify_failures(failures).groupBy("owner").agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in ("new", "persistent", "intermittent")],
        F.count(F.lit(1)).alias("total"),
    )


def classify_failures(failures: DataFrame) -> DataFrame:
    return failures.withColumn(
        "category",
        F.expr("case when not exists(history, h -> h) then 'new' when forall(history, h -> h) then 'persistent' else 'intermittent' end"),
    )


def slowest_new_failures(failures: DataFrame, limit: int = 5) -> DataFrame:
    return (
        classify_failures(failures).filter("category = 'new'").orderBy(F.desc("duration_ms"), "id").limit(limit).select("id", "duration_ms")
    )


def workload_concurrency(audit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak of concurrent jobs and the window they took, from start and end
    rows: keys, ``phase, ns``."""
    steps = audit.withColumn("step", F.when(F.col("phase") == "start", 1).otherwise(-1))
    deltas = steps.groupBy(*keys, F.col("ns").alias("ts")).agg(F.sum("step").alias("step"))
    swept = running(deltas, list(keys), ["ts"], {"open": Run("sum", F.col("step"))})
    return swept.groupBy(*keys).agg(
        F.expr("nullif(greatest(max(open), 0L), 0L) as peak"), F.expr("max(ts) - min(ts) as window_ns")
    )


def protocol_checks(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Runs whose jobs do not match the plan exactly once, or start out of order.

    ``expected``: ``run, key, position``; ``observed``: ``run, key, ts``.
    """
    want = expected.groupBy("run", "key").agg(F.count(F.lit(1)).alias("wanted"), F.min("position").alias("position"))
    got = observed.groupBy("run", "key").agg(F.count(F.lit(1)).alias("seen"), F.min("ts").alias("ts"))
    both = want.join(got, ["run", "key"], "full")
    mismatch = both.groupBy("run").agg(
        F.expr("count_if(coalesce(wanted, 0) != coalesce(seen, 0)) as mismatched"),
    )
    placed = running(both.filter("ts is not null and position is not null"), ["run"], ["position", "key"], {"before": Run("max_before", F.col("ts"))})
    order = placed.groupBy("run").agg(F.expr("count_if(before > ts) as out_of_order"))
    return mismatch.join(order, "run", "left").selectExpr("run", "mismatched", "coalesce(out_of_order, 0L) as out_of_order")


def recording_checks(t: AgentTrace) -> DataFrame:
    """Data-quality assertions with the number of violations of each."""
    runs = t["capture_runs"]
    twice = runs.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).agg(F.expr("count_if(n > 1) as violations"))
    last = t.tables["counter"].groupBy("track_id").agg(F.max_by("value", "ts").alias("value"))
    closing = last.join(
        t["counter_tracks"].filter("name in ('llm.tokens.input', 'llm.tokens.output')").selectExpr("id as track_id"), "track_id"
    ).agg(F.expr("count_if(value != 0) as violations"))
    open_flows = t.tables["flow"].join(t.tables["slice"].selectExpr("id as slice_out"), "slice_out", "left_anti").agg(
        F.expr("count(*) as violations")
    )
    backwards = t["slices"].agg(F.expr("count_if(dur < -1) as violations"))
    orphaned = t["tool_calls"].filter("parent_call_id is not null").join(
        t["tool_calls"].filter("call_id is not null").selectExpr("capture_id", "call_id as parent_call_id").distinct(),
        ["capture_id", "parent_call_id"], "left_anti",
    ).agg(F.expr("count(*) as violations"))
    clocks = clock_errors(t).withColumnRenamed("clock_errors", "violations")
    named = {
        "capture has one session": twice, "token counters close at zero": closing, "flows start at a slice": open_flows,
        "durations are not negative": backwards, "nested calls name a known call": orphaned, "clocks are aligned": clocks,
    }
    out = None
    for name, frame in named.items():
        row = frame.select(F.lit(name).alias("check"), F.col("violations").cast("bigint").alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out


def worker_overlap_check(workers: DataFrame, reviewers: DataFrame) -> DataFrame:
    """Per run: whether all workers overlapped, and whether the reviewer began
    after the last of them: ``run, start_ts, end_ts`` on both sides."""
    w = workers.groupBy("run").agg(
        F.max("start_ts").alias("last_start"), F.min("end_ts").alias("first_end"), F.max("end_ts").alias("last_end"),
        F.count(F.lit(1)).alias("workers"),
    )
    r = reviewers.groupBy("run").agg(F.min("start_ts").alias("review_start"))
    return w.join(r, "run", "left").selectExpr(
        "run", "workers", "workers > 1 and last_start < first_end as workers_overlap", "review_start >= last_end as review_after"
    )


def capture_union_length(t: AgentTrace) -> DataFrame:
    """Union and peak of all completed work per capture."""
    return interval_union_length(work_intervals(t), ["capture_id"], blocks=t.blocks("capture_id"))
