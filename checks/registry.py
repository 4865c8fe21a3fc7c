"""The named queries: every frame and report over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import ingest_queries, stream_queries
from spanloom.plans import activity, captures, context, models, runtime, sessions, tools, turns  # noqa: F401
from spanloom.plans.trace import VIEWS, AgentTrace
from spanloom.session import configure
from spanloom.sources.binding import bind_events

Query = Callable[[SparkSession, str], DataFrame]
_TRACES: dict[tuple[str, str], AgentTrace] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings; on one machine also as many shuffle partitions as cores,
    since two hundred tiny state stores or files would only add overhead."""
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return configure(spark)


def trace(spark: SparkSession, sf_dir: str) -> AgentTrace:
    """The trace of a folder, shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _TRACES:
        _TRACES[key] = AgentTrace(bind_events(prepared(spark), key[1]))
    return _TRACES[key]


def shaped(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Result form: booleans as 0/1."""
    out = [
        F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
        for f in df.schema.fields
        if f.name not in drop
    ]
    return df.select(*out)


#: Columns that only serve other frames.
_HIDDEN = {
    "slices": ("attrs",),
    "messages": ("track_id", "cache_write_tokens", "stop_reason"),
    "capture_markers": ("track_id", "peak_context_tokens"),
    "captures": ("marker_peak_context",),
    "configuration": ("id", "session_labels"),
    "tool_preflights": ("pre_truncated", "pre_intent", "pre_args"),
    "session_captures": ("child_role", "subagent_type"),
}
#: Frames that are steps of others and no report of their own.
_INTERNAL = {"counter_totals", "prompt_cluster_members", "turn_operations"}


def _frame(name: str) -> Query:
    return lambda spark, sf_dir: shaped(trace(spark, sf_dir)[name], _HIDDEN.get(name, ()))


def _report(build: Callable[[AgentTrace], DataFrame]) -> Query:
    return lambda spark, sf_dir: shaped(build(trace(spark, sf_dir)))


def _plain(build: Query) -> Query:
    return lambda spark, sf_dir: shaped(build(prepared(spark), sf_dir.rstrip("/")))


def _kind_rules(t: AgentTrace) -> DataFrame:
    return t["slices"].groupBy("name", "category", "kind").agg(F.count(F.lit(1)).alias("slices"))


def _descendants(t: AgentTrace) -> DataFrame:
    return sessions.capture_descendants(
        t, t["capture_hierarchy"].filter("root_capture_id = capture_id and parent_capture_id is null")
    )


def _waterfall(t: AgentTrace) -> DataFrame:
    """The turn with the most operations."""
    busiest = t["turn_bounds"].orderBy(F.desc("events"), "prompt_id").select("prompt_id").first()
    return turns.turn_waterfall(t, busiest["prompt_id"] if busiest else -1)


def _sql_waterfall(t: AgentTrace) -> DataFrame:
    """The same by SQL text alone, over a view and a table function."""
    t.register("sql_", ("turn_bounds",))
    turns.register_functions(t, "sql_")
    return t.spark.sql("""
        SELECT w.* FROM (SELECT prompt_id FROM sql_turn_bounds ORDER BY events DESC, prompt_id LIMIT 1) AS p
        JOIN LATERAL sql_turn_waterfall(p.prompt_id) AS w""")


def _sql_usage(t: AgentTrace) -> DataFrame:
    """Captures, tool calls and turns of each harness and model, by SQL text over registered views."""
    t.register("sql_", ("capture_runs", "tool_calls", "turns"))
    return t.spark.sql("""
        WITH calls AS (SELECT capture_id, count(*) AS calls, count(DISTINCT name) AS tools FROM sql_tool_calls GROUP BY capture_id),
        asked AS (SELECT capture_id, count(*) AS prompts, max(display_end_ts - start_ts) AS longest_ns FROM sql_turns GROUP BY capture_id)
        SELECT r.harness, r.model, count(*) AS captures, sum(coalesce(c.calls, 0)) AS calls, max(coalesce(c.tools, 0)) AS most_tools,
               sum(coalesce(a.prompts, 0)) AS prompts, max(a.longest_ns) AS longest_ns,
               count(*) FILTER (WHERE r.incomplete > 0) AS with_open_work
        FROM sql_capture_runs AS r LEFT JOIN calls AS c ON c.capture_id = r.capture_id LEFT JOIN asked AS a ON a.capture_id = r.capture_id
        GROUP BY r.harness, r.model""")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _frame(name) for name in VIEWS if name not in _INTERNAL}
    out |= {
        "kind_rules": _report(_kind_rules),
        "capture_descendants": _report(_descendants),
        "slow_tools": _report(tools.slow_tools),
        "turn_waterfall": _report(_waterfall),
        "sql_turn_waterfall": _report(_sql_waterfall),
        "sql_usage": _report(_sql_usage),
        "turns_page": _report(turns.turns_page),
        "slowest_turns": _report(turns.slowest_turns),
        "top_context_changes": _report(context.top_context_changes),
    }
    out |= {name: _plain(build) for name, build in (ingest_queries.QUERIES | stream_queries.QUERIES).items()}
    return out
