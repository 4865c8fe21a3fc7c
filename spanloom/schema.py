"""Trace schema and the fixed values the recorders write."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Values recorders write into traces; they must match the recorded data.

#: Namespaces of slice categories, besides the trace's own vendor namespace.
HARNESSES = ("pi", "claude", "codex", "muse")

#: Slices that open a capture, and those that describe its configuration.
MARKER_NAMES = ("tracing", "tracing-start")
PROFILE_PATTERN = r"(?s)^profile \([0-9].*\)$"
CONFIGURATION_NAME = "run-configuration"

NOT_RECORDED = "Not recorded"
LEGACY_CAPTURE = "Legacy capture"

#: metric, display name, group
COUNTERS = (
    ("context.system", "System instructions", "Context"),
    ("context.rules", "Rules and memory", "Context"),
    ("context.skills", "Skills", "Context"),
    ("context.tools", "Tool definitions", "Context"),
    ("context.environment", "Environment", "Context"),
    ("context.prompts", "User prompts", "Context"),
    ("context.assistant", "Assistant history", "Context"),
    ("context.results", "Tool results", "Context"),
    ("context.summaries", "Compaction summaries", "Context"),
    ("context.overhead", "Harness overhead", "Context"),
    ("context.messages", "Conversation", "Context"),
    ("context.unattributed", "Unattributed", "Context"),
    ("llm.tokens.input", "Input tokens", None),
    ("llm.tokens.output", "Output tokens", None),
    ("llm.context.estimated_tokens", "Context size", None),
    ("llm.context.window_tokens", "Context window", None),
    ("runtime.rss", "Resident memory", "Runtime"),
    ("runtime.heap", "JS heap", "Runtime"),
    ("runtime.cpu", "CPU time (interval)", "Runtime"),
    ("tracing.droppedEvents", "Dropped events", "Tracing"),
    ("tracing.queueDepth", "Queue depth", "Tracing"),
    ("tracing.laneOverflows", "Lane overflows", "Tracing"),
)
#: One more spelling of a metric, from older recordings.
COUNTER_ALIASES = {"llm.context.estimated_tokens": ("Context size (est.)",)}
RUNTIME_METRICS = ("runtime.rss", "runtime.heap", "runtime.cpu")

#: Import statistics that mean a clock could not be aligned.
CLOCK_ERRORS = (
    "clock_sync_failure_no_path",
    "clock_sync_failure_undeferrable_packet_loss",
    "clock_sync_unrelatable_clock_domains",
    "trace_sorter_negative_timestamp_dropped",
    "invalid_clock_snapshots",
)

#: Attribute -> (type, recorded keys, current one first).  ``{v}`` stands for
#: the vendor prefix of older recordings.
ATTRIBUTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "kind": ("string", ("kind", "{v}_event_kind")),
    "capture_id": ("string", ("capture_id", "{v}_capture_id")),
    "session_id": ("string", ("session_id", "{v}_session_id")),
    "label": ("string", ("label", "{v}_capture_label")),
    "harness": ("string", ("harness", "{v}_harness")),
    "provider": ("string", ("provider", "{v}_llm_provider")),
    "model": ("string", ("model", "{v}_llm_model")),
    "effort": ("string", ("effort", "{v}_llm_effort")),
    "context_window_tokens": ("bigint", ("context_window_tokens",)),
    "peak_context_tokens": ("bigint", ("peak_context_tokens",)),
    "schema_version": ("bigint", ("schema_version",)),
    "unavailable_child_sessions": ("bigint", ("unavailable_child_sessions",)),
    "incomplete": ("int", ("incomplete", "pi_tracing_incomplete")),
    "provider_incomplete": ("int", ("incomplete", "pi_tracing_providerIncomplete")),
    "timing": ("string", ("timing",)),
    "duration_ns": ("bigint", ("duration_ns", "{v}_stream_duration_ns")),
    "first_content_ns": ("bigint", ("first_content_ns", "{v}_stream_first_content_ns")),
    "input_tokens": ("bigint", ("input_tokens", "{v}_usage_input")),
    "output_tokens": ("bigint", ("output_tokens", "{v}_usage_output")),
    "cache_read_tokens": ("bigint", ("cache_read_tokens", "{v}_usage_cacheRead")),
    "cache_write_tokens": ("bigint", ("cache_write_tokens", "{v}_usage_cacheWrite")),
    "stop_reason": ("string", ("stop_reason", "{v}_llm_stopReason")),
    "phase": ("string", ("phase",)),
    "call_id": ("string", ("call_id", "{v}_tool_call_id")),
    "parent_call_id": ("string", ("parent_call_id",)),
    "is_error": ("int", ("is_error", "{v}_tool_is_error")),
    "language": ("string", ("language",)),
    "line_count": ("bigint", ("line_count",)),
    "args_truncated": ("int", ("args_truncated",)),
    "truncated": ("int", ("truncated",)),
    "intent": ("string", ("intent",)),
    "parent_session": ("string", ("parent_session", "parentSession")),
    "child_session": ("string", ("child_session", "childSession")),
    "child_role": ("string", ("child_role", "childRole")),
    "subagent_type": ("string", ("subagent_type", "subagentType")),
    "role": ("string", ("role",)),
    "correlation": ("string", ("correlation",)),
    "delegation": ("int", ("delegation",)),
    "text": ("string", ("text",)),
    "turn_id": ("string", ("turn_id",)),
    "request_id": ("string", ("request_id",)),
    "pre_tokens": ("bigint", ("pre_tokens", "tokens_before")),
    "post_tokens": ("bigint", ("post_tokens", "tokens_after")),
}
#: Scalar fields of a context snapshot (recorded under ``context.``).
CONTEXT_FIELDS = {
    "version": "bigint",
    "sample_offset_ns": "bigint",
    "stage": "string",
    "item_stage": "string",
    "basis": "string",
    "coverage": "string",
    "baseline": "int",
    "model": "string",
    "estimated_tokens": "bigint",
    "reported_tokens": "bigint",
    "window_tokens": "bigint",
    "effective_window_tokens": "bigint",
    "compact_threshold_tokens": "bigint",
    "omitted_changes": "bigint",
}
#: Fields of one item change inside a snapshot.
CHANGE_FIELDS = {
    "id": "string",
    "category": "string",
    "change": "string",
    "tokens": "bigint",
    "delta_tokens": "bigint",
    "chars": "bigint",
    "source_id": "string",
    "source_kind": "string",
    "label": "string",
}
CONTEXT_CATEGORIES = tuple(name.split(".", 1)[1] for name, _, group in COUNTERS if group == "Context")
# ------------------------------------------------------------ end fixed values

_CHANGES = "array<struct<" + ",".join(f"{n}:{t}" for n, t in CHANGE_FIELDS.items()) + ">>"
CONTEXT_TYPE = (
    "struct<"
    + ",".join(f"{n}:{t}" for n, t in CONTEXT_FIELDS.items())
    + f",categories:map<string,bigint>,changes:{_CHANGES}>"
)
#: All attribute columns of a slice with their types.
ATTRIBUTE_TYPES: dict[str, str] = {n: t for n, (t, _) in ATTRIBUTES.items()} | {
    "session_labels": "array<string>",
    "args": "map<string,string>",
    "context": CONTEXT_TYPE,
}
ATTRS_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in ATTRIBUTE_TYPES.items()) + ">"

#: Table name -> DDL of the trace tables.  ``attrs`` is the typed form of the
#: key/value arguments, so a scan reads only the attributes a query touches.
TABLES: dict[str, str] = {
    "slice": (
        "id bigint, parent_id bigint, track_id bigint, ts bigint, dur bigint, name string, category string, "
        f"attrs {ATTRS_TYPE}"
    ),
    "track": "id bigint, parent_id bigint, name string, machine_id bigint, trace_id bigint",
    "process_track": "id bigint, upid bigint",
    "process_counter_track": "id bigint, upid bigint",
    "thread_track": "id bigint, utid bigint",
    "process": "upid bigint, labels array<string>",
    "thread": "utid bigint, upid bigint, tid bigint, name string",
    "counter_track": "id bigint, name string",
    "counter": "track_id bigint, ts bigint, value double",
    "flow": "slice_out bigint, slice_in bigint",
    "stats": "name string, severity string, value bigint",
}


def struct_type(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
