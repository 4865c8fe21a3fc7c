"""Tool executions, agent-written scripts and the calls nested in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.attributes import total_sql
from spanloom.operators.trees import expand_edges
from spanloom.plans.trace import AgentTrace, view


_DONE = "not incomplete and dur >= 0"


@view()
def tool_preflights(t: AgentTrace) -> DataFrame:
    """Latest preflight slice per capture and call; older recordings kept tool
    metadata there."""
    return (
        t["slices"]
        .filter("name = 'tool-preflight' and attrs.call_id is not null")
        .groupBy("capture_id", F.expr("attrs.call_id as call_id"))
        .agg(F.max_by(F.struct("id", "attrs.truncated", "attrs.intent", "attrs.args"), F.col("id")).alias("p"))
        .selectExpr(
            "capture_id", "call_id", "p.id as id", "p.truncated as pre_truncated", "p.intent as pre_intent", "p.args as pre_args"
        )
    )


def _calls(t: AgentTrace) -> DataFrame:
    calls = t["slices"].filter("kind in ('tool-execution', 'script', 'model-call')").withColumn(
        "call_id", F.expr("attrs.call_id")
    )
    return calls.join(t["tool_preflights"].withColumnRenamed("id", "preflight_id"), ["capture_id", "call_id"], "left")


_CALL_COLUMNS = (
    "id", "capture_id", "session", "ts", "dur", "name", "category", "kind", "incomplete", "call_id",
    "attrs.parent_call_id as parent_call_id", "attrs.is_error as is_error",
    "coalesce(attrs.timing, 'recorded-span') as timing",
    """coalesce(nullif(attrs.language, ''),
        if(kind = 'script' and name = 'codemode' and category = 'pi.tools', 'JavaScript', null)) as language""",
    "attrs.line_count as line_count",
    "coalesce(attrs.args_truncated, pre_truncated, 0) as args_truncated",
)
_PAYLOAD_COLUMNS = (
    "coalesce(nullif(trim(attrs.intent), ''), nullif(trim(pre_intent), '')) as intent",
    # arguments in key order, so equal calls give equal text
    "to_json(map_from_entries(array_sort(map_entries(coalesce(attrs.args, pre_args))))) as arguments",
)


@view()
def tool_calls(t: AgentTrace) -> DataFrame:
    """Tool, script and scripted model calls, without payloads."""
    return _calls(t).selectExpr(*_CALL_COLUMNS)


@view()
def tool_call_details(t: AgentTrace) -> DataFrame:
    """Tool calls with intent and arguments."""
    return _calls(t).selectExpr(*_CALL_COLUMNS, *_PAYLOAD_COLUMNS)


@view(keep=True)
def script_children(t: AgentTrace) -> DataFrame:
    """Calls reached from each script over parent call ids of the same capture,
    each once, with its shortest depth; a cycle ends where it began."""
    calls = t["tool_calls"]
    parents = calls.filter("call_id is not null").selectExpr("capture_id", "call_id", "id as parent_id", "kind as parent_kind")
    children = calls.filter("parent_call_id is not null").selectExpr("capture_id", "parent_call_id as call_id", "id")
    edges = parents.join(children, ["capture_id", "call_id"]).filter("id != parent_id")
    scripts = calls.filter("kind = 'script'").selectExpr("id as seed")
    return expand_edges(edges, scripts).filter("depth > 0").selectExpr("seed as script_id", "id", "depth")


@view()
def tools_overview(t: AgentTrace) -> DataFrame:
    return t["tool_calls"].filter("kind = 'tool-execution'").groupBy(F.col("name").alias("tool")).agg(
        F.expr("count(*) as calls"),
        F.expr(f"{total_sql('dur', 'not incomplete')} / 1e6D as work_ms"),
        F.expr("max(dur) filter (where not incomplete) / 1e6D as longest_ms"),
        F.expr("if(count(is_error) = 0, null, count_if(is_error = 1)) as errors"),
        F.expr("count(is_error) as outcomes"),
        F.expr("count_if(incomplete) as incomplete"),
    )


@view()
def tool_summary(t: AgentTrace) -> DataFrame:
    return t["tool_calls"].groupBy("capture_id", "kind", F.col("name").alias("operation"), "timing").agg(
        F.expr("count(*) as calls"),
        F.expr("count_if(incomplete) as incomplete"),
        F.expr(f"count_if({_DONE}) as duration_samples"),
        F.expr(f"{total_sql('dur', _DONE)} / 1e6D as summed_work_ms"),
        F.expr(f"max(dur) filter (where {_DONE}) / 1e6D as longest_ms"),
        F.expr("count(is_error) as outcome_samples"),
        F.expr("if(count(is_error) = 0, null, count_if(is_error = 1)) as errors"),
    )


@view()
def scripts(t: AgentTrace) -> DataFrame:
    """Scripts with the number of calls nested in them."""
    nested = t["script_children"].groupBy("script_id").agg(F.count(F.lit(1)).alias("calls"))
    rows = t["tool_call_details"].filter("kind = 'script'")
    return rows.join(nested, rows["id"] == nested["script_id"], "left").selectExpr(
        "id", "capture_id", "ts", "name as script", "if(dur >= 0, dur / 1e6D, null) as duration_ms", "is_error",
        "incomplete", "intent", "arguments", "args_truncated", "kind", "language", "line_count",
        "coalesce(calls, 0L) as calls",
    )


@view()
def script_calls(t: AgentTrace) -> DataFrame:
    """The calls nested in scripts."""
    return t["script_children"].join(t["tool_call_details"], "id").selectExpr(
        "script_id", "id", "ts", "name as tool", "depth", "kind", "if(dur >= 0, dur / 1e6D, null) as duration_ms",
        "is_error", "incomplete", "intent", "arguments", "args_truncated", "language", "line_count",
    )


def slow_tools(t: AgentTrace, limit: int = 50) -> DataFrame:
    """The slowest tool calls, unfinished ones first."""
    return (
        t["tool_calls"]
        .filter("kind = 'tool-execution'")
        .selectExpr(
            "id", "capture_id", "name as tool", "ts", f"if({_DONE}, dur / 1e6D, null) as duration_ms", "incomplete",
            "is_error", "timing", f"if({_DONE}, dur, null) as done_ns",
        )
        .orderBy(F.desc("incomplete"), F.desc_nulls_last("done_ns"), "id")
        .limit(limit)
        .drop("done_ns")
    )
