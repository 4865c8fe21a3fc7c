"""Queries of the ingest stages, item sets and comparisons.

Their inputs are journals, spans, logs and runs that Spark derives from the
given tables, row by row, so the work grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.functions import text
from spanloom.operators.blocks import Run, running
from spanloom.operators.intervals import interval_sweep as sweep
from spanloom.plans import compare, ingest, items, load
from spanloom.plans.activity import CLASSES, work_intervals
from spanloom.schema import TABLES
from spanloom.session import shared_folder
from spanloom.sources import journals
from spanloom.sources.journal_source import write_journals
from spanloom.sources.binding import numbered_events, plain_events
from spanloom.sources.tables import read_trace_tables as read_trace_tables_, write_trace_tables

QUERIES: dict = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def ev(spark: SparkSession, sf: str, *where: str) -> DataFrame:
    """Plain events (``id, u, typ, k, cents, ns``), filtered."""
    out = plain_events(spark.read.parquet(f"{sf}/events.parquet"))
    for w in where:
        out = out.filter(w)
    return out


def nev(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their neighbours in the session."""
    return numbered_events(spark.read.parquet(f"{sf}/events.parquet"))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).groupBy("u").agg(F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"))


S = "concat('session-', u) as session"
UUID = """concat(substring(md5(cast(u as string)), 1, 8), '-', substring(md5(cast(u as string)), 9, 4), '-',
 substring(md5(cast(u as string)), 13, 4), '-', substring(md5(cast(u as string)), 17, 4), '-', substring(md5(cast(u as string)), 21, 12))"""


# ------------------------------------------------------------------ journals
def _lines(spark, sf) -> DataFrame:
    good = "to_json(named_struct('source', typ, 'timestamp', cast(ns as string), 'data', named_struct('cents', cents, 'k', k)))"
    return ev(spark, sf).selectExpr(
        "u as recording", "id as seq",
        f"""case k % 13 when 0 then substring({good}, 1, 30) when 1 then replace({good}, typ, '')
             when 2 then replace({good}, concat('"', ns, '"'), cast(ns as string))
             when 3 then concat('{{"source":"x","timestamp":"', ns, '","data":[1]}}') when 4 then '[1,2]' else {good} end as line""",
    )


@query
def parse_observations(spark, sf):
    return journals.parse_observations(_lines(spark, sf)).withColumn("timestamp", F.col("timestamp").cast("bigint"))


def _written_journals(spark, sf) -> str:
    """Journal files of all events: three chunks a session, every fifth session compressed, every seventh broken off after each chunk."""
    path = f"{shared_folder(spark)}/journals-{uuid.uuid4().hex}"
    lines = _lines(spark, sf).selectExpr("recording", "seq % 3 as chunk", "seq", "line", "true as committed")
    cut = ev(spark, sf, "u % 7 = 0").selectExpr("u as recording", "id % 3 as chunk").distinct()
    lines = lines.unionByName(cut.selectExpr("recording", "chunk", "9000000000L as seq", """'{"source":"hook","timestamp":"1","data":{}}' as line""", "false as committed"))
    write_journals(lines.filter("recording % 5 <> 0"), path)
    write_journals(lines.filter("recording % 5 = 0"), path, "gzip")
    head = sessions(spark, sf).selectExpr(
        "u as recording", "cast(null as bigint) as chunk", "0L as seq",
        """concat('[{"source":"process_start","timestamp":"', first_ns, '","data":{"pid":', u, '}},{"source":"clock_snapshot","timestamp":"', first_ns, '","data":{}}]') as line""",
    )
    write_journals(head, path)
    return path


@query
def read_journal(spark, sf):
    """Observations of each recording, read from journal files with ranges of 16 KB: rows, damaged rows, chunks with damage."""
    found = journals.read_journal(spark, _written_journals(spark, sf), splitBytes="16384")
    return found.groupBy(F.expr("cast(recording as bigint)").alias("recording")).agg(
        F.expr("count_if(source <> 'recovery') as rows"),
        F.expr("coalesce(sum(cast(get_json_object(data, '$.corrupt_records') as bigint)) filter (where source = 'recovery'), 0L) as corrupt"),
        F.expr("count_if(source = 'recovery') as damaged_chunks"),
        F.expr("cast(sum(timestamp) filter (where source <> 'recovery') % 1000000007 as bigint) as clocks"),
    )


@query
def read_chunked_journal(spark, sf):
    """All observations of captures: heads, chunks and recovery rows."""
    found = journals.read_chunked_journal(spark, _written_journals(spark, sf))
    return found.selectExpr(
        "cast(recording as bigint) as recording", "chunk", "source", "cast(timestamp as bigint) as timestamp", "replace(data, '.gz', '') as data",
    )


def _mod_lines(spark, sf) -> DataFrame:
    """Lines of a recorder of begins and ends: prompts, responses, tools with executions, launched agents and compactions of each session."""

    def row(ts: str, event: str, phase: str, id_: str, **more: str) -> str:
        fields = {"event": f"'{event}'", "phase": f"'{phase}'", "id": id_, "session_id": "concat('session-', u)"} | more
        return f"""struct({ts} as ts, to_json(named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})) as data)"""

    def usage(**parts: str) -> str:
        return f"""named_struct({', '.join(f"'{k}', {v}" for k, v in parts.items())})"""

    worker = "concat('w', id)"
    rows = {
        "signup": [row("ns", "prompt", "begin", "concat('p', id)", prompt="concat('please ', k)"), "if(k % 4 <> 0, " + row("ns + cents * 40000000000", "prompt", "end", "concat('p', id)") + ", null)"],
        "view": [
            row("ns", "response", "begin", "concat('r', id)", model="concat('m', k % 3)"),
            "if(k % 4 <> 0, " + row("ns + cents * 1000000", "response", "end", "concat('r', id)", usage=usage(
                input_tokens="if(k % 7 = 0, null, k * 100)", output_tokens="k * 10", cache_read_input_tokens="k", cache_creation_input_tokens="if(k % 2 = 0, 3L, null)")) + ", null)",
        ],
        "click": [
            row("ns", "tool", "begin", "concat('c', id)", tool="'Bash'"),
            row("ns + cents * 1000000", "execution", "end", "concat('c', id)", duration_ms="if(k % 3 = 0, cents + 5D, cents * 0.5D)", is_error="k % 5 = 0"),
            "if(k % 4 <> 0, " + row("ns + cents * 1000000 + 2000000", "tool", "end", "concat('c', id)", is_error="k % 5 = 0") + ", null)",
        ],
        "error": [
            row("ns", "tool", "begin", "concat('l', id)", tool="'Agent'"),
            row("ns + 1000", "agent", "begin", worker, agent_id=worker, call_id="concat('l', id)", role="'auditor'", model="'child'", prompt="'verify'"),
            row("ns + 2000", "response", "begin", "concat('x', id)", agent_id=worker, model="'child'"),
            row("ns + 5000", "response", "end", "concat('x', id)", agent_id=worker, usage=usage(input_tokens="4L", output_tokens="7L")),
            "if(k % 2 = 0, " + row("ns + 6000", "prompt", "end", "concat('x', id)", agent_id=worker) + ", null)",
            "if(k % 4 <> 0, " + row("ns + 7000", "tool", "end", "concat('l', id)", is_error="false") + ", null)",
        ],
        "purchase": [
            row("ns", "compaction", "begin", "concat('k', id)", trigger="if(k % 2 = 0, 'precompute', 'manual')"),
            "if(k % 4 <> 0, " + row("ns + cents * 1000", "compaction", "end", "concat('k', id)", success="true", pre_tokens="k * 50", post_tokens="if(k % 3 <> 0, k * 10, null)") + ", null)",
        ],
    }
    parts = [
        ev(spark, sf, f"typ = '{typ}'").selectExpr("u as recording", "id", f"posexplode(array({', '.join(some)})) as (pos, r)").filter("r is not null")
        for typ, some in rows.items()
    ]
    begin = row("first_ns", "session", "begin", "concat('session-', u)", model="concat('m', u % 3)")
    end = row("last_ns + 10000000000000", "session", "end", "concat('session-', u)", reason="'exit'", dropped="u % 2")
    parts.append(sessions(spark, sf).selectExpr("u as recording", "-1L as id", f"posexplode(array({begin}, if(u % 3 = 0, {end}, null))) as (pos, r)").filter("r is not null"))
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines.selectExpr(
        "recording", "pmod(id, 3) as chunk", "id * 10 + pos as seq",
        """concat('{"source":"claude.mod","timestamp":"', r.ts, '","data":', r.data, '}') as line""",
    )


@query
def ingest_journals(spark, sf):
    """Journal files loaded as trace tables in two batches: slices, counters and flows."""
    path = f"{shared_folder(spark)}/load-{uuid.uuid4().hex}"
    write_journals(_mod_lines(spark, sf), f"{path}/journals")
    found = journals.read_journal(spark, f"{path}/journals")
    store = load.TraceStore(spark, f"{path}/traces")
    store.load(0, found.filter("chunk = 0"))
    store.load(1, found.filter("chunk > 0"))
    tables = store.tables()
    scope = tables["slice"].filter("attrs.kind = 'capture'").selectExpr("track_id as scope_track", "attrs.session_id as scope")
    root = tables["track"].selectExpr("id as track_id", "parent_id as root", "name as track")
    scoped = root.join(root.join(scope, F.col("track_id") == F.col("scope_track")).select("root", "scope"), "root")
    slices = tables["slice"].join(scoped, "track_id")
    first = slices.selectExpr(
        "'slice' as part", "scope", "concat(track, ':', name) as name", "ts", "dur as value",
        "concat_ws('/', attrs.kind, attrs.incomplete, attrs.model, attrs.timing, attrs.child_session, attrs.is_error, attrs.text, attrs.parent_session) as detail",
    )
    counters = tables["counter"].join(scoped, "track_id").selectExpr("'counter' as part", "scope", "track as name", "ts", "cast(value as bigint) as value", "cast(null as string) as detail")
    ends = slices.select("id", "scope", F.concat("track", F.lit(":"), "name").alias("name"), "ts")
    flows = (
        tables["flow"].join(ends.withColumnsRenamed({"id": "slice_out"}), "slice_out")
        .join(ends.selectExpr("id as slice_in", "scope as scope_in", "name as name_in", "ts as ts_in"), "slice_in")
        .selectExpr("'flow' as part", "scope", "concat(name, '>', name_in) as name", "ts", "ts_in as value", "scope_in as detail")
    )
    return first.unionByName(counters).unionByName(flows)


def _span_batches(spark, sf) -> DataFrame:
    def attrs() -> str:
        return """array(named_struct('key', 'session.id', 'value', to_json(named_struct('stringValue', concat('session-', u)))),
            named_struct('key', 'n', 'value', to_json(named_struct('intValue', k - 5))),
            named_struct('key', 'ok', 'value', '{"boolValue":true}'), named_struct('key', 'n2', 'value', '{"doubleValue":0.5}'))"""

    # attribute values are objects, so the batch text is put together from parts
    attr_text = f"concat('[', array_join(transform({attrs()}, a -> concat('{{\"key\":\"', a.key, '\",\"value\":', a.value, '}}')), ','), ']')"
    own = f"""concat('{{"traceId":"t', u, '","spanId":"s', id, '","parentSpanId":"', if(k % 4 = 0 or prev_id is null, '', concat('s', prev_id)),
        '","name":"', typ, '","startTimeUnixNano":"', ns, '","endTimeUnixNano":"', if(k % 10 = 9, ns - 1, ns + cents * 1000),
        '","status":{{"code":', if(k % 8 = 0, 2, 1), '}},"attributes":', {attr_text}, '}}')"""
    again = """if(k % 5 = 0 and prev_id is not null, concat(',{"traceId":"t', u, '","spanId":"s', prev_id,
        '","name":"resent","startTimeUnixNano":"', ns - 1000, '","endTimeUnixNano":"', ns, '","attributes":[]}'), '')"""
    return nev(spark, sf).selectExpr(
        "u as recording", "id as seq",
        f"""concat('{{"resourceSpans":[{{"scopeSpans":[{{"spans":[', {own}, {again}, ']}}]}}]}}') as data""",
    )


@query
def flatten_otlp_spans(spark, sf):
    return journals.flatten_otlp_spans(_span_batches(spark, sf)).selectExpr(
        "recording", "trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "cast(is_error as int) as is_error",
        "attrs['session.id'] as session", "attrs['n'] as n", "attrs['ok'] as ok", "attrs['n2'] as n2",
    )


@query
def otel_attributes(spark, sf):
    """How often each attribute key keeps a value."""
    spans = journals.flatten_otlp_spans(_span_batches(spark, sf))
    return spans.select(F.explode("attrs").alias("key", "value")).groupBy("key").agg(
        F.count(F.lit(1)).alias("spans"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def _log_batches(spark, sf, *where: str) -> DataFrame:
    iso = "date_format(timestamp_millis(ns div 1000000), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    record = f"""concat('{{"traceId":"t', u, '","timeUnixNano":"', if(k % 4 = 0, 0, ns), '","attributes":[{{"key":"event.name","value":{{"stringValue":"', typ,
        '"}}}},{{"key":"event.timestamp","value":{{"stringValue":"', {iso}, '"}}}},{{"key":"conversation.id","value":{{"stringValue":"', {UUID}, '"}}}}]}}')"""
    return ev(spark, sf, *where).selectExpr(
        "u as recording", "inline(if(k % 3 = 0, array(struct(id as seq), struct(id + 1000000000 as seq)), array(struct(id as seq))))",
        "'otel' as source", f"concat('{{\"resourceLogs\":[{{\"scopeLogs\":[{{\"logRecords\":[', {record}, ']}}]}}]}}') as data",
    )


@query
def flatten_otlp_logs(spark, sf):
    return journals.flatten_otlp_logs(_log_batches(spark, sf)).selectExpr(
        "recording", "trace_id", "at_ns", "attrs['event.name'] as event_name", "attrs['conversation.id'] as conversation"
    )


@query
def captured_session_ids(spark, sf):
    client = ev(spark, sf, "typ = 'signup'").selectExpr(
        "u as recording", "id as seq", "'cli' as source",
        f"""to_json(named_struct('type', if(k % 2 = 0, 'thread.started', 'other'), 'thread_id',
            if(k % 3 = 0, 'none', concat(substring({UUID}, 1, 24), lpad(cast(k as string), 12, '0'))))) as data""",
    )
    return journals.captured_session_ids(client.unionByName(_log_batches(spark, sf, "typ <> 'signup'")))


def _exports(spark, sf) -> DataFrame:
    def envelope(eid: str, stream: str, kind: str, fields: str) -> str:
        return f"""concat('{{"id":"', {eid}, '","stream":{{"id":"', {stream}, '"}},"recorded_at":', ns div 1000,
            ',"payload_type":"event","payload":{{"kind":"run","run_id":"r', k, '","event":{{"kind":"{kind}",', {fields}, '}}}}}}')"""

    me = "concat('x', id)"
    done = envelope(me, me, "model_completed", """'"duration_ms":', k, ',"model":"m","secret":"no"'""")
    other = envelope("concat('y', id)", "'elsewhere'", "completed", """'"a":1'""")
    ended = envelope("concat('z', id)", me, "cancelled", """'"reason":"user"'""")
    return ev(spark, sf).selectExpr(
        f"{me} as session",
        f"""concat('{{"export_schema_version":1,"events":[{{"kind":"record","envelope":', {done}, '}},{{"kind":"record","envelope":', {done},
            '}},{{"kind":"record","envelope":', {other}, '}},{{"kind":"retained_frame","envelope":{{"children":[{{"record_json":',
            to_json(struct({ended} as t)), '}}]}}}},{{"kind":"gap","marker":"', if(k % 2 = 0, 'omitted_live_only', 'lost'), '"}}]}}') as doc""",
    ).selectExpr(
        "session",
        # the retained child is JSON inside a JSON string: take it out of its carrier object
        r"""regexp_replace(doc, '"record_json":\\{"t":("(?:[^"\\\\]|\\\\.)*")\\}', '"record_json":$1') as doc""",
    )


@query
def flatten_session_export(spark, sf):
    return journals.flatten_session_export(_exports(spark, sf))


@query
def export_diagnostics(spark, sf):
    return journals.export_diagnostics(_exports(spark, sf))


@query
def read_transcripts(spark, sf):
    lines = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "cast(conv_id as string) as file", "concat('s', conv_id) as session", "turn as seq",
        "case when turn = 0 or (turn = 3 and conv_id % 2 = 0) then 'session_meta' when turn = 4 then 'token_usage_record' else 'response_item' end as type",
        "if(conv_id % 3 = 0, concat('s', conv_id), 'other') as thread_id",
        "if(turn = 0, concat('s', conv_id), 'parent') as payload_id",
    )
    return ingest.read_transcripts(lines).select("file", "seq", "type")


# ------------------------------------------------------------------- pairing
@query
def pair_begin_end(spark, sf):
    """Three ids per scope and event, used again and again, with overlapping operations."""
    steps = ev(spark, sf).selectExpr(
        "concat('s', u) as scope", "typ as event", "id % 3 as id",
        """inline(array_compact(array(named_struct('phase', 'begin', 'ts', ns),
            if(k % 4 != 0, named_struct('phase', 'end', 'ts', ns + cents * 40000000000), null))))""",
    )
    ends = sessions(spark, sf).filter("u % 3 = 0").selectExpr("concat('s', u) as scope", "last_ns + 1 as end_ts")
    return ingest.pair_begin_end(steps, ends)


def _hooks(spark, sf) -> DataFrame:
    return ev(spark, sf, "typ in ('click', 'purchase')").selectExpr(
        S, "if(typ = 'click', concat('c', id), null) as call_id", "if(k % 2 = 0, 'Bash', 'read') as tool",
        "if(k % 2 = 0, k % 3, null) as exit_code", "if(k % 7 = 0, null, k % 5 = 0) as is_error",
        """inline(case when typ = 'click' then array_compact(array(named_struct('hook', 'PreToolUse', 'ts', ns),
               if(k % 4 != 0, named_struct('hook', 'PostToolUse', 'ts', ns + cents * 1000), null)))
             when k % 4 = 3 then array(named_struct('hook', 'PreCompact', 'ts', ns))
             when k % 4 = 1 then array(named_struct('hook', 'PostCompact', 'ts', ns)) else array() end)""",
    )


@query
def pair_hook_dispatch(spark, sf):
    native = ev(spark, sf, "typ = 'click' and k % 6 = 0").selectExpr(S, "concat('c', id) as call_id")
    return ingest.pair_hook_dispatch(_hooks(spark, sf), native, F.lit(2_000_000_000_000_000_000))


@query
def place_reported_duration(spark, sf):
    rows = ev(spark, sf).selectExpr(
        "id", "ns as start_ts", "ns + cents * 100000 as end_ts", "if(k % 5 = 0, null, k * 100000 * (1 + k % 3) * 20) as reported_ns"
    )
    return ingest.place_reported_duration(rows)


@query
def fallback_unmatched_tools(spark, sf):
    spans = ev(spark, sf, "typ = 'click' and k % 3 != 0").selectExpr(S, "concat('c', id) as call_id")
    last = sessions(spark, sf).selectExpr(S, "last_ns as last_ts")
    return ingest.fallback_unmatched_tools(_hooks(spark, sf).filter("call_id is not null"), spans, last)


# ------------------------------------------------------------------ matching
@query
def match_completion_to_stream(spark, sf):
    """Three completions around each view, 2 ms apart, and up to three streams that several of them are near to."""
    views = ev(spark, sf, "typ = 'view'")
    completions = views.selectExpr(S, "inline(transform(sequence(0, 2), j -> struct(id * 3 + j as id, ns + j * 2000000 as ts)))").select("id", "session", "ts")
    streams = views.selectExpr(
        S, """inline(array_compact(array(
            if(k % 3 != 0, named_struct('id', id * 3, 'start_ts', ns - 5000000, 'end_ts', ns + (k % 9 - 2) * 1000000), null),
            if(k % 7 = 0, named_struct('id', id * 3 + 1, 'start_ts', ns - 7000000, 'end_ts', ns + 1000000), null),
            if(k % 2 = 0, named_struct('id', id * 3 + 2, 'start_ts', ns + 2000000, 'end_ts', ns + 4000000), null))))""",
    )
    return ingest.match_completion_to_stream(completions, streams)


@query
def match_prompt_log(spark, sf):
    turns = ev(spark, sf, "typ = 'signup'").selectExpr("id", S, "ns as start_ts", "ns + cents * 40000000000 as end_ts")
    logs = ev(spark, sf, "typ = 'view'").selectExpr("id", S, "ns as ts")
    return ingest.match_prompt_log(turns, logs)


@query
def match_usage_sample(spark, sf):
    rows = ev(spark, sf, "typ = 'view'")
    responses = rows.selectExpr("id", S, "ns as end_ts", "k * 100 as input_tokens", "if(k % 6 = 0, null, k * 10) as output_tokens")
    samples = rows.selectExpr(
        "id", S, "ns + (k % 11 - 3) * 200000000 as ts", "if(k % 5 = 0, k, k * 100) as input_tokens", "k * 10 as output_tokens"
    )
    return ingest.match_usage_sample(responses, samples)


@query
def exclude_control_events(spark, sf):
    rows = ev(spark, sf, "typ = 'signup'")
    prompts = rows.selectExpr("id", S, "ns as ts", "k % 10 as length")
    controls = rows.filter("k % 2 = 0").selectExpr("id", S, "ns + (k % 4) * 900000000 as ts", "(k + k % 3) % 10 as length")
    return ingest.exclude_control_events(prompts, controls)


@query
def asof_configuration(spark, sf):
    points = ev(spark, sf, "typ = 'click'").selectExpr("id", S, "ns as ts")
    configurations = ev(spark, sf, "typ = 'signup'").selectExpr(
        "id", S, "ns as ts", "concat('model-', k % 3) as model", "if(k % 2 = 0, 'high', null) as effort", "'p' as provider"
    )
    return ingest.asof_configuration(points, configurations)


@query
def asof_last_response(spark, sf):
    tools = ev(spark, sf, "typ in ('click', 'error')").selectExpr("id", S, "ns as ts")
    return ingest.asof_last_response(tools, ev(spark, sf, "typ = 'view'").selectExpr("id", S, "ns as ts"))


@query
def owner_prompt_containing(spark, sf):
    prompts = ev(spark, sf, "typ = 'signup'").selectExpr("id", S, "ns as start_ts", "ns + cents * 20000000000 as end_ts")
    return ingest.owner_prompt_containing(ev(spark, sf, "typ = 'click'").selectExpr("id", S, "ns as ts"), prompts)


@query
def classify_by_containment(spark, sf):
    responses = ev(spark, sf, "typ = 'view'").selectExpr("id", S, "ns as ts", "ns + cents * 1000000000 as end_ts")
    compactions = ev(spark, sf, "typ = 'purchase'").selectExpr("id", S, "ns as ts", "ns + cents * 30000000000 as end_ts")
    return ingest.classify_by_containment(responses, compactions)


# --------------------------------------------------------------------- trees
def _spans(spark, sf) -> DataFrame:
    return nev(spark, sf).selectExpr(
        "id", "if(k % 5 != 0, prev_id, null) as parent_id", "concat('t', u div 2) as trace_id",
        "if(k % 6 = 0, concat('session-', u), null) as session", "ns as start_ts", "ns + cents * 1000 as end_ts",
        "k % 3 = 0 as mapped",
    )


@query
def inherit_scope_from_ancestors(spark, sf):
    return ingest.inherit_scope_from_ancestors(_spans(spark, sf))


@query
def nearest_mapped_ancestor_edges(spark, sf):
    return ingest.nearest_mapped_ancestor_edges(_spans(spark, sf))


@query
def route_telemetry(spark, sf):
    captures = sessions(spark, sf).filter("u % 3 != 0").selectExpr(
        S, "u as capture_id", "first_ns as start_ts", "if(u % 4 = 0, null, first_ns + (last_ns - first_ns) div 2) as end_ts"
    )
    return ingest.route_telemetry(_spans(spark, sf), captures)


@query
def reachable_sessions(spark, sf):
    s = sessions(spark, sf)
    # a binary tree of sessions, closed into a cycle at its first node
    links = s.selectExpr("u as child", "(u - 1) div 2 as parent").filter("child > 0").unionByName(
        s.filter("u = 5").selectExpr("0L as child", "u as parent")
    )
    return ingest.reachable_sessions(links, s.selectExpr("u as session"), s.filter("u % 7 != 6").selectExpr("u as session"))


@query
def link_delegations(spark, sf):
    e = ev(spark, sf, "typ = 'error'")
    launches = e.selectExpr("id", S, "concat('c', id) as call_id", "if(k % 3 != 0, concat('kid-', id), null) as child_session", "ns as ts")
    kids = e.filter("k % 3 != 2").selectExpr(
        "concat('kid-', id) as session", "concat('session-', u) as parent_session", "if(k % 3 = 0, concat('c', id), null) as launch_call"
    )
    inputs = e.filter("k % 4 != 0").selectExpr("concat('kid-', id) as session", "inline(array(struct(id * 10 as id, ns + 5 as ts), struct(id * 10 + 1 as id, ns + 4 as ts)))")
    return ingest.link_delegations(launches, kids, inputs)


@query
def delegation_flow_id(spark, sf):
    return sessions(spark, sf).selectExpr("u", f"{UUID} as session").select(
        "u", "session", text.delegation_flow_id(F.col("session")).alias("flow_id")
    )


@query
def extract_child_session(spark, sf):
    results = ev(spark, sf).selectExpr(
        "id", f"concat(repeat('spawn ', cast(k * 20 as int)), if(k % 3 = 0, 'none', {UUID}), ' done') as result"
    )
    return results.select("id", text.child_session(F.col("result")).alias("child_session"))


@query
def lifecycle_snapshots_to_spans(spark, sf):
    snapshots = ev(spark, sf, "typ = 'purchase'").selectExpr(
        "u as script", "id as call_id", "if(k % 9 = 0, 'other', 'models.classify') as name",
        """inline(array_compact(array(if(k % 5 != 0, named_struct('status', 'running', 'ts', ns), null),
             if(k % 5 != 0, named_struct('status', 'running', 'ts', ns + 10), null),
             if(k % 3 != 0, named_struct('status', if(k % 2 = 0, 'ok', 'error'), 'ts', ns + 100 + cents), null))))""",
    )
    return ingest.lifecycle_snapshots_to_spans(snapshots, sessions(spark, sf).selectExpr("u as script", "last_ns + 1000000 as end_ts"))


# ---------------------------------------------------------- states and series
@query
def run_configuration_changes(spark, sf):
    rows = ev(spark, sf, "typ = 'view'").selectExpr(
        "id", S, "ns as ts", "concat('model-', k div 40) as model", "if(k % 4 = 0, null, 'high') as effort"
    )
    return ingest.run_configuration_changes(rows)


def _usage(spark, sf) -> DataFrame:
    return ev(spark, sf, "typ = 'view'").selectExpr(
        "id", S, "ns as end_ts", "if(k % 7 = 0, null, k * 100) as input_tokens", "if(k % 5 = 0, null, k * 10) as output_tokens",
        "if(k % 3 = 0, null, k) as cache_read_tokens", "k * 2 as cache_write_tokens",
    )


@query
def cumulative_counters(spark, sf):
    bounds = sessions(spark, sf).selectExpr(S, "first_ns as start_ts", "last_ns + 1 as end_ts")
    return ingest.cumulative_counters(_usage(spark, sf), bounds)


@query
def context_gauge(spark, sf):
    compactions = ev(spark, sf, "typ = 'purchase'").selectExpr(
        S, "ns as start_ts", "ns + cents as end_ts", "if(k % 4 = 0, null, k * 50) as before_tokens",
        "if(k % 3 = 0, null, k * 10) as after_tokens", "k % 5 = 0 as incomplete",
    )
    return ingest.context_gauge(_usage(spark, sf), compactions)


@query
def clip_to_capture(spark, sf):
    slices = ev(spark, sf).selectExpr("id", S, "ns as start_ts", "ns + cents * 10000000000 as end_ts", "k % 10 = 9 as incomplete")
    windows = sessions(spark, sf).selectExpr(S, "first_ns + (last_ns - first_ns) div 4 as start_ts", "last_ns - (last_ns - first_ns) div 4 as end_ts")
    return ingest.clip_to_capture(slices, windows)


@query
def session_bounds(spark, sf):
    evidence = ev(spark, sf).selectExpr("u div 10 as recording", S, "ns as start_ts", "ns + cents as end_ts")
    process = sessions(spark, sf).filter("u % 10 = 0").selectExpr("u div 10 as recording", S, "first_ns - 100 as start_ts", "last_ns + 100 as end_ts")
    return ingest.session_bounds(evidence, process)


@query
def segment_revisited_sessions(spark, sf):
    rows = ev(spark, sf).selectExpr("id", "concat('session-', u div 3) as session", "u % 3 as segment", "ns as ts")
    return ingest.segment_revisited_sessions(rows).select("id", "session", "native_session", "segment")


@query
def union_recordings(spark, sf):
    """Local ids and parents, read back through the new unique ids."""
    e = nev(spark, sf).selectExpr("u as recording", "id as local_id", "prev_id as local_parent")
    machines = e.selectExpr("1 as machine_id")
    one = ingest.union_recordings([e.filter("recording % 2 = 0"), e.filter("recording % 2 = 1")], machines)
    parents = one.selectExpr("id as parent_id", "recording as parent_recording", "local_id as parent_local")
    return one.join(parents, "parent_id", "left").select("recording", "local_id", "parent_recording", "parent_local")


@query
def close_partial_recording(spark, sf):
    events = ev(spark, sf, "typ != 'error'").selectExpr("u as track_id", "id", "if(k % 3 != 0, 'begin', 'end') as phase", "ns as ts")
    counters = ev(spark, sf, "typ = 'error'").selectExpr("u + 1000000 as track_id", "ns as ts", "k as value")
    return ingest.close_partial_recording(events, counters)


@query
def align_clocks(spark, sf):
    rows = ev(spark, sf, "typ = 'click'").selectExpr("id", "u as recording", "k % 3 as clock", "ns - 12345 as ts")
    snapshots = ev(spark, sf, "typ = 'signup' and k % 3 != 2").selectExpr(
        "id", "u as recording", "k % 3 as clock", "ns - 1000 * k as source_ts", "ns as realtime"
    )
    return ingest.align_clocks(rows, snapshots)


@query
def native_usage_totals(spark, sf):
    return ingest.native_usage_totals(_usage(spark, sf).withColumnRenamed("session", "run"))


# ---------------------------------------------------------------------- text
def _documents(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def privacy_findings(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join(text.privacy_findings(F.col("text")), ",").alias("findings"))


@query
def bounded_prompt_text(spark, sf):
    p = _documents(spark, sf).select("doc_id", text.bounded_prompt(F.col("text")).alias("p"))
    return p.selectExpr("doc_id", "p.length as length", "md5(p.text) as kept", "p.truncated as truncated")


@query
def script_line_count(spark, sf):
    return _documents(spark, sf).select("doc_id", text.line_count(F.col("text")).alias("lines"))


@query
def estimate_tokens(spark, sf):
    t = F.col("text")
    return _documents(spark, sf).select(
        "doc_id", text.estimate_tokens(t).alias("by_chars"), text.estimate_tokens_of_bytes(F.octet_length(t)).alias("by_bytes")
    )


def _attribute_map(spark, sf) -> DataFrame:
    return ev(spark, sf).selectExpr(
        "id",
        """map('event.name', typ, 'session.id', concat('s', u), 'prompt', 'secret', 'prompt_length', cast(k as string),
               'input_tokens', cast(k as string), 'tool.output', 'text', 'duration_ms', cast(cents as string), 'free', 'x') as attrs""",
    )


@query
def redact_content(spark, sf):
    rows = _attribute_map(spark, sf)
    return rows.select(
        "id",
        F.array_join(F.array_sort(F.map_keys(text.redact_attributes(F.col("attrs")))), ",").alias("attributes"),
        F.array_join(F.array_sort(F.map_keys(text.redact_fields(F.col("attrs")))), ",").alias("fields"),
    )


@query
def bounded_arguments(spark, sf):
    rows = ev(spark, sf).selectExpr(
        "id", "to_json(map_from_entries(transform(sequence(1, cast(1 + k % 15 as int)), i -> struct(concat('key', i), k)))) as args"
    )
    return rows.select("id", text.bounded_arguments(F.col("args")).alias("a")).selectExpr(
        "id", "a.bytes as bytes", "array_join(a.keys, ',') as keys", "a.keys_truncated as keys_truncated"
    )


@query
def parse_exit_status(spark, sf):
    rows = ev(spark, sf, "typ in ('click', 'error')").selectExpr(
        "id", S, "concat('c', id) as call_id", "if(k % 3 = 0, 'read', 'shell') as tool",
        "if(k % 4 = 0, 'killed', concat('Process exited with code ', k % 5 - 1)) as output", "k % 11 = 0 as denied",
    ).withColumn("exit_code", text.exit_code(F.col("tool"), F.col("output")))
    denied = rows.filter("denied").select("session", "call_id").distinct().withColumn("was_denied", F.lit(True))
    return rows.drop("denied").join(denied, ["session", "call_id"], "left").selectExpr(
        "id", "exit_code", "if(was_denied, true, exit_code != 0) as is_error"
    )


# ----------------------------------------------------------------- item sets
def _conversations(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


@query
def transcript_items(spark, sf):
    tools = "named_struct('name', concat('tool', turn % 3), 'description', text)"
    messages = _conversations(spark, sf).selectExpr(
        "conv_id as scope", "turn as seq", "role", "text",
        "if(turn % 2 = 0, map('project rules', if(turn % 4 = 2, null, text), concat('skill ', turn % 3), text), null) as sections",
        f"if(turn % 3 = 0, array({tools}), null) as tools_added", "if(turn % 5 = 4, array('tool0', 'tool2'), null) as tools_removed",
    )
    return items.transcript_items(messages)


def _item_sets(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Each message stays for three samples, in the order of its conversation."""
    c = running(
        _conversations(spark, sf).selectExpr("conv_id as scope", "turn", "role", "text"), ["scope"], ["turn"],
        {"n": Run("row_number")},
    ).withColumn("sample", F.col("n") - 1)
    size = c.groupBy("scope").agg(F.max("sample").alias("last"))
    present = c.join(size, "scope").selectExpr(
        "scope", "concat('m', sample) as item_id", "sample as made", "role", "length(text) as chars",
        "explode(sequence(sample, least(sample + 2, last))) as sample",
    )
    rows = present.select(
        "scope", "sample", "item_id", items.role_category(F.col("role")).alias("category"),
        F.expr("ceil(chars / 4) + if((sample - made) = 2 and made % 2 = 0, 5, 0) as tokens"),
    )
    return rows, c.selectExpr("scope", "sample", "concat('model-', sample div 4) as model")


@query
def context_diff(spark, sf):
    return items.context_diff(*_item_sets(spark, sf))


@query
def retained_changes(spark, sf):
    rows, samples = _item_sets(spark, sf)
    return items.retained_changes(items.context_diff(rows, samples))


@query
def snapshot_totals(spark, sf):
    rows, samples = _item_sets(spark, sf)
    return items.snapshot_totals(rows, items.context_diff(rows, samples))


@query
def encode_sparse_items(spark, sf):
    return items.encode_sparse_items(*_item_sets(spark, sf))


@query
def fold_sparse_items(spark, sf):
    return items.fold_sparse_items(items.encode_sparse_items(*_item_sets(spark, sf)))


@query
def category_counters(spark, sf):
    rows, samples = _item_sets(spark, sf)
    per = rows.groupBy("scope", F.col("sample").alias("ts"), "category").agg(F.sum("tokens").alias("tokens"))
    # one entry per category: at most a dozen
    snapshots = per.groupBy("scope", "ts").agg(F.map_from_entries(F.collect_list(F.struct("category", "tokens"))).alias("categories"))
    ends = samples.groupBy("scope").agg((F.max("sample") + 1).alias("end_ts"))
    return items.category_counters(snapshots, ends)


# --------------------------------------------------------------- comparisons
def _trace(spark, sf):
    from checks.registry import trace

    return trace(spark, sf)


@query
def compare_runs(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    runs = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).selectExpr(
        "o_orderpriority as case_name", "c_mktsegment as variant", "o_orderstatus = 'F' as correct", "o_orderkey % 3 != 0 as conformant",
        "o_orderkey % 5 != 0 as valid", "if(o_orderkey % 7 = 0, null, cast(round(o_totalprice * 100) as bigint)) as cents", "o_orderkey % 1000 as calls",
    )
    return compare.compare_runs(runs, ["case_name", "variant"], ["cents", "calls"])


@query
def interval_sweep(spark, sf):
    """Segments of each capture with the concurrency of each class."""
    t = _trace(spark, sf)
    return sweep(work_intervals(t), ["capture_id"], CLASSES, blocks=t.blocks("capture_id"))


@query
def read_trace_tables(spark, sf):
    """Rows of each trace table, written and read back."""
    path = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    write_trace_tables(_trace(spark, sf).tables, path)
    again = read_trace_tables_(spark, path)
    out = None
    for name in TABLES:
        row = again[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query
def run_breakdown(spark, sf):
    return compare.run_breakdown(_trace(spark, sf))


@query
def scripted_tool_stats(spark, sf):
    return compare.scripted_tool_stats(_trace(spark, sf))


@query
def reconcile_usage(spark, sf):
    manifest = ev(spark, sf).groupBy(F.col("u").alias("capture_id")).agg(
        F.expr("coalesce(sum(k * 100 + cents % 97) filter (where typ = 'view' and k % 7 != 0), 0) + u % 2 as input_tokens"),
        F.expr("coalesce(sum(k * 10) filter (where typ = 'view' and k % 5 != 0), 0) as output_tokens"),
        F.expr("count_if(typ = 'view') as responses"),
        F.expr("count_if(typ in ('click', 'error')) + if(u % 3 = 0, 1, 0) as tools"),
        F.expr("count_if(typ = 'purchase' and k % 4 = 0) as scripts"),
        F.expr("0L as nested"),
    )
    return compare.reconcile_usage(_trace(spark, sf), manifest)


@query
def baseline_delta(spark, sf):
    runs = _trace(spark, sf)["capture_runs"].select("capture_id", "input_tokens")
    base = runs.orderBy("capture_id").limit(1)
    return compare.baseline_delta(runs, base, "input_tokens")


@query
def context_pressure_delta(spark, sf):
    runs = _trace(spark, sf)["capture_runs"].select("capture_id", "context_window_tokens", "context_share", "peak_context")
    return compare.context_pressure_delta(runs, runs.filter("context_share is not null").orderBy("capture_id").limit(1))


def _failures(spark, sf) -> DataFrame:
    """Every order with the history of all its lines, however many; one without lines has an empty history.
    A line failed if any of its rows did."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(
        F.expr("coalesce(bool_or(l_returnflag = 'R'), false) as failed")
    )
    histories = lines.groupBy("l_orderkey").agg(F.expr("array_sort(collect_list(struct(l_linenumber, failed))).failed as history"))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.join(histories, orders["o_orderkey"] == histories["l_orderkey"], "left").selectExpr(
        "o_orderkey as id", "o_orderpriority as owner", "cast(round(o_totalprice * 100) as bigint) as duration_ms",
        "coalesce(history, cast(array() as array<boolean>)) as history",
    )


@query
def failure_history_audit(spark, sf):
    return compare.failure_history_audit(_failures(spark, sf))


@query
def slowest_new_failures(spark, sf):
    return compare.slowest_new_failures(_failures(spark, sf))


@query
def workload_concurrency(spark, sf):
    audit = ev(spark, sf, "typ = 'click'").selectExpr(
        "u as run", "inline(array(struct('start' as phase, ns), struct('end' as phase, ns + cents * 10000000000 as ns)))"
    )
    return compare.workload_concurrency(audit, ["run"])


@query
def protocol_checks(spark, sf):
    expected = ev(spark, sf, "typ = 'click'").selectExpr("u as run", "concat('job', k % 20) as key", "k % 20 as position").distinct()
    observed = ev(spark, sf, "typ = 'error'").selectExpr("u as run", "concat('job', k % 20) as key", "ns as ts")
    return compare.protocol_checks(expected, observed)


@query
def recording_checks(spark, sf):
    return compare.recording_checks(_trace(spark, sf))


@query
def worker_overlap_check(spark, sf):
    h = _trace(spark, sf)["delegation"].filter("parent_capture_id is not null")
    workers = h.filter("capture_id % 5 != 0").selectExpr("parent_capture_id as run", "start_ts", "end_ts")
    reviewers = h.filter("capture_id % 5 = 0").selectExpr("parent_capture_id as run", "start_ts", "end_ts")
    return compare.worker_overlap_check(workers, reviewers)


@query
def interval_union_length(spark, sf):
    return compare.capture_union_length(_trace(spark, sf))


@query
def peak_concurrency(spark, sf):
    return compare.capture_union_length(_trace(spark, sf)).drop("active_ns")
