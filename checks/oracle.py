"""The same results in plain SQL, for an independent engine.

``CTES`` maps the ``events`` table to traces and builds the shared relations;
``FINAL`` holds one statement per query.  :func:`sql_for` adds the CTEs a
statement needs.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
FINAL: dict[str, str] = {}


def S(expr: str, where: str | None = None) -> str:
    """Sum as BIGINT (the engine's integer sums are wider)."""
    return f"CAST(sum({expr}){f' FILTER (WHERE {where})' if where else ''} AS BIGINT)"


def C(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


H = "CASE u % 4 WHEN 0 THEN 'pi' WHEN 1 THEN 'claude' WHEN 2 THEN 'codex' ELSE 'muse' END"

CTES["ev0"] = """
SELECT event_id AS id, user_id AS u, event_type AS typ, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) * 1000 AS ns
FROM events"""
CTES["ev"] = f"""
SELECT *, {H} AS h,
  CASE WHEN typ = 'signup' THEN 'prompt' WHEN typ = 'view' THEN 'assistant-message'
       WHEN typ IN ('click', 'error') THEN 'tool-execution'
       ELSE CASE k % 4 WHEN 0 THEN 'script' WHEN 1 THEN 'provider-request' WHEN 2 THEN 'model-call'
         ELSE CASE WHEN k % 8 = 7 THEN 'tool-preflight' ELSE 'compaction' END END
  END AS kind,
  typ IN ('click', 'error') OR (typ = 'purchase' AND k % 4 IN (0, 2)) AS is_call,
  lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id,
  sum(CASE WHEN typ = 'view' AND k % 7 <> 0 THEN k * 100 + cents % 97 END) OVER w AS sum_input,
  sum(CASE WHEN typ = 'view' AND k % 5 <> 0 THEN k * 10 END) OVER w AS sum_output
FROM ev0 WINDOW w AS (PARTITION BY u ORDER BY ns, id)"""
CTES["ev_calls"] = """
SELECT id, max_call AS prev_call FROM (SELECT id, is_call, last_value(CASE WHEN is_call THEN id END IGNORE NULLS)
  OVER (PARTITION BY u ORDER BY ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS max_call FROM ev)"""
CTES["sess"] = """
SELECT u, min(ns) AS first_ns, max(ns) AS last_ns,
       arg_min(id, (ns, id)) FILTER (WHERE typ = 'signup') AS first_prompt,
       min(ns) FILTER (WHERE typ = 'signup') AS first_prompt_ns,
       arg_min(id, (ns, id)) FILTER (WHERE typ IN ('click', 'error')) AS first_tool
FROM ev GROUP BY u"""
CTES["event_slices"] = """
SELECT e.id, CASE WHEN k % 5 = 0 THEN coalesce(prev_id, -1000000000000 - u) WHEN u % 8 = 7 THEN -1000000000000 - u END AS parent_id,
  -(u * 16 + CASE WHEN u % 8 = 7 THEN 7 WHEN is_call THEN 2 ELSE 4 END) AS track_id, ns AS ts,
  CASE WHEN k % 20 = 19 THEN -1 WHEN kind = 'prompt' THEN cents * 40000000000 ELSE cents * 10000000000 END AS dur,
  CASE kind WHEN 'prompt' THEN 'prompt' WHEN 'assistant-message' THEN 'assistant ttft=' || (k % 10) || 'ms'
    WHEN 'provider-request' THEN 'request' WHEN 'tool-execution' THEN 'tool-' || (k % 6) WHEN 'script' THEN 'codemode'
    WHEN 'model-call' THEN 'sub-model' ELSE kind END AS name,
  h || CASE WHEN kind = 'prompt' THEN '.agent' WHEN is_call THEN '.tools'
    WHEN kind IN ('assistant-message', 'provider-request') THEN '.llm' ELSE '.context' END AS category,
  kind, k, u, cents, is_call, prev_id, typ,
  CASE WHEN typ = 'error' THEN 1 WHEN typ = 'click' AND k % 3 <> 0 THEN 0 END AS is_error,
  CASE WHEN is_call THEN 'c' || e.id WHEN kind = 'tool-preflight' THEN 'c' || prev_call END AS call_id,
  CASE WHEN is_call AND k % 3 = 1 THEN 'c' || prev_call END AS parent_call_id,
  typ = 'error' AND k % 6 = 1 AND u % 7 = 2 AS launch,
  CASE WHEN k % 3 = 0 THEN 't' || k END AS turn_id,
  CASE WHEN typ IN ('view', 'purchase') THEN 'r' || (k % 8) END AS request_id
FROM ev e LEFT JOIN ev_calls USING (id)"""
CTES["session_slices"] = f"""
SELECT -1000000000000 - u AS id, CAST(NULL AS BIGINT) AS parent_id, first_ns AS ts, 'capture' AS kind,
       CASE WHEN u % 5 = 0 THEN 'profile (1)' WHEN u % 2 = 0 THEN 'tracing' ELSE 'tracing-start' END AS name,
       {H} || '.metadata' AS category, u FROM sess
UNION ALL
SELECT -2000000000000 - u, -1000000000000 - u, last_ns, 'configuration', 'run-configuration', {H} || '.metadata', u FROM sess
UNION ALL
SELECT -1 - first_prompt, -1000000000000 - u, first_prompt_ns, 'prompt-input', 'prompt-input', {H} || '.agent', u FROM sess
WHERE first_prompt IS NOT NULL"""
CTES["slices"] = """
SELECT id, parent_id, track_id, u AS capture_id, 'session-' || u AS session,
       CASE WHEN u % 3 <> 0 THEN 'run ' || (u % 3) ELSE substr(printf('%x', u + 4096), 1, 8) END AS capture,
       ts, dur, name, category, kind, dur < 0 OR k % 10 = 9 AS incomplete, k, cents, typ, is_error, call_id, parent_call_id,
       launch, turn_id, request_id, prev_id,
       CASE WHEN k % 4 = 0 THEN 'native-duration' END AS timing
FROM event_slices
UNION ALL
SELECT id, parent_id, -(u * 16 + CASE WHEN u % 8 = 7 THEN 7 ELSE 4 END), u, 'session-' || u,
       CASE WHEN u % 3 <> 0 THEN 'run ' || (u % 3) ELSE substr(printf('%x', u + 4096), 1, 8) END,
       ts, 0, name, category, kind, false, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, NULL, NULL, NULL
FROM session_slices"""
CTES["config"] = f"""
SELECT u AS capture_id, {H} AS harness, CASE WHEN u % 6 <> 0 THEN 'provider-' || (u % 2) END AS provider,
       'model-' || (u % 3) AS model, CASE WHEN u % 3 <> 0 THEN 'effort-' || (u % 2) END AS effort,
       CASE WHEN u % 2 = 0 THEN 200000 END AS context_window_tokens FROM sess
UNION ALL
SELECT u, {H}, CASE WHEN u % 6 <> 0 THEN 'provider-' || (u % 2) END, 'model-' || ((u + 1) % 3),
       CASE WHEN u % 3 <> 0 THEN 'effort-' || (u % 2) END, CASE WHEN u % 5 = 0 THEN 100000 END FROM sess"""
CTES["config_known"] = """
SELECT capture_id, harness, coalesce(provider, 'Not recorded') AS provider, model, coalesce(effort, 'Not recorded') AS effort,
       CAST(context_window_tokens AS BIGINT) AS context_window_tokens FROM config"""
CTES["config_lists"] = """
SELECT capture_id, string_agg(DISTINCT harness, ',' ORDER BY harness) AS harness,
       string_agg(DISTINCT provider, ',' ORDER BY provider) AS provider, string_agg(DISTINCT model, ',' ORDER BY model) AS model,
       string_agg(DISTINCT effort, ',' ORDER BY effort) AS effort, max(context_window_tokens) AS context_window_tokens,
       count(DISTINCT context_window_tokens) AS windows
FROM config_known GROUP BY capture_id"""
_METRICS = [
    ("llm.tokens.input", "Input tokens", "typ = 'view' AND k % 7 <> 0", "sum_input"),
    ("llm.tokens.output", "Output tokens", "typ = 'view' AND k % 5 <> 0", "sum_output"),
    ("llm.context.estimated_tokens", "Context size", "typ = 'view' AND k % 2 = 0", "k * 10"),
    ("runtime.rss", "Resident memory", "typ = 'click'", "cents"),
    ("runtime.cpu", "CPU time (interval)", "typ = 'view' AND k % 3 = 0", "k"),
    ("tracing.droppedEvents", "Dropped events", "typ = 'purchase' AND u % 3 = 0", "k % 3"),
    ("tracing.queueDepth", "Queue depth", "typ = 'purchase'", "k"),
]
CTES["samples"] = " UNION ALL ".join(
    f"SELECT u AS capture_id, -(u * 16 + {8 + j}) AS track_id, '{m}' AS name, '{d}' AS display_name, ns AS ts,"
    f" CAST({v} AS DOUBLE) AS value FROM ev WHERE {w}"
    for j, (m, d, w, v) in enumerate(_METRICS)
) + "".join(
    f" UNION ALL SELECT u, -(u * 16 + {8 + j}), '{m}', '{d}', last_ns + 1, CAST(0 AS DOUBLE) FROM sess"
    for j, (m, d, _, _) in enumerate(_METRICS[:4])
)
CTES["track_maxima"] = "SELECT capture_id, track_id, name, display_name, max(value) AS maximum FROM samples GROUP BY ALL"
CTES["totals"] = """
SELECT capture_id, sum(maximum) FILTER (WHERE name = 'llm.tokens.input') AS input_tokens,
       sum(maximum) FILTER (WHERE name = 'llm.tokens.output') AS output_tokens,
       max(maximum) FILTER (WHERE name = 'llm.context.estimated_tokens') AS counter_peak,
       max(maximum) FILTER (WHERE name = 'tracing.droppedEvents') AS dropped_events,
       max(maximum) FILTER (WHERE name = 'tracing.queueDepth') AS queue_depth_peak
FROM track_maxima GROUP BY capture_id"""
CTES["runs"] = f"""
SELECT s.*, (end_ts - start_ts) / 1e6 AS duration_ms, printf('%x', capture_id + 4096) AS recorded_id,
       harness, provider, model, effort, context_window_tokens, input_tokens, output_tokens,
       CASE WHEN capture_id % 3 = 0 THEN '["label-' || (capture_id % 4) || '","plan"]' END AS session_labels,
       CASE WHEN capture_id % 4 = 0 THEN CAST(capture_id * 1000 AS DOUBLE) ELSE counter_peak END AS peak_context,
       CASE WHEN windows = 1 AND context_window_tokens > 0
            THEN CASE WHEN capture_id % 4 = 0 THEN CAST(capture_id * 1000 AS DOUBLE) ELSE counter_peak END
                 / context_window_tokens END AS context_share
FROM (SELECT capture_id, session, any_value(capture) AS capture, min(ts) AS start_ts, max(ts + greatest(dur, 0)) AS end_ts,
             {C("kind = 'prompt'")} AS turns, {C("kind = 'assistant-message'")} AS responses,
             {C("kind = 'tool-execution'")} AS tools, {C("incomplete")} AS incomplete
      FROM slices GROUP BY capture_id, session) s
JOIN config_lists USING (capture_id) LEFT JOIN totals USING (capture_id)"""
CTES["messages"] = """
SELECT id, capture_id, session, ts, dur, name, incomplete, 'provider-' || (k % 2) AS provider, 'model-' || (k % 3) AS model,
       coalesce(timing, 'recorded-span') AS timing, CASE WHEN dur > 0 THEN dur END AS message_ns,
       CASE WHEN dur > 0 THEN ts END AS message_start_ts,
       CASE WHEN k % 3 <> 0 THEN (CASE WHEN dur < 0 THEN -((-dur) // (k % 9 + 2)) ELSE dur // (k % 9 + 2) END) END AS first_ns,
       CASE WHEN k % 7 <> 0 THEN k * 100 + cents % 97 END AS input_tokens, CASE WHEN k % 5 <> 0 THEN k * 10 END AS output_tokens,
       CASE WHEN k % 2 = 0 THEN k END AS cache_read_tokens, request_id, turn_id, k
FROM slices WHERE kind = 'assistant-message'"""
CTES["preflights"] = """
SELECT capture_id, call_id, max(id) AS id FROM slices WHERE name = 'tool-preflight' AND call_id IS NOT NULL GROUP BY ALL"""
CTES["calls"] = """
SELECT s.id, s.capture_id, s.session, s.ts, s.dur, s.name, s.category, s.kind, s.incomplete, s.call_id, s.parent_call_id, s.is_error,
       coalesce(s.timing, 'recorded-span') AS timing,
       CASE WHEN s.kind = 'script' THEN CASE WHEN s.k % 8 = 0 THEN 'Python' WHEN s.category = 'pi.tools' THEN 'JavaScript' END END AS language,
       CASE WHEN s.kind = 'script' THEN s.k END AS line_count,
       CASE WHEN s.k % 11 = 0 OR p.k % 3 = 0 THEN 1 ELSE 0 END AS args_truncated,
       CASE WHEN s.k % 2 = 0 THEN 'step ' || (s.k % 12) WHEN p.id IS NOT NULL THEN 'planned ' || p.k END AS intent,
       CASE WHEN s.k % 4 <> 3 THEN '{"n":"' || s.k || '","path":"f' || (s.cents % 10) || '"}'
            WHEN p.id IS NOT NULL THEN '{"pre":"' || p.k || '"}' END AS arguments
FROM slices s LEFT JOIN preflights f ON f.capture_id = s.capture_id AND f.call_id = s.call_id LEFT JOIN slices p ON p.id = f.id
WHERE s.kind IN ('tool-execution', 'script', 'model-call')"""
CTES["nested_paths"] = """
SELECT p.id AS script_id, c.id, 1 AS depth FROM calls p JOIN calls c
  ON c.capture_id = p.capture_id AND c.parent_call_id = p.call_id WHERE p.kind = 'script' AND c.id <> p.id
UNION ALL
SELECT n.script_id, c.id, n.depth + 1 FROM nested_paths n JOIN calls p ON p.id = n.id
  JOIN calls c ON c.capture_id = p.capture_id AND c.parent_call_id = p.call_id WHERE c.id <> p.id AND c.id <> n.script_id"""
CTES["nested"] = "SELECT script_id, id, min(depth) AS depth FROM nested_paths GROUP BY ALL"
CTES["flows"] = """
SELECT id AS slice_out, next_id AS slice_in FROM ev WHERE k % 7 < 2 AND next_id IS NOT NULL
UNION ALL
SELECT p.first_tool, -1 - c.first_prompt FROM sess c
JOIN sess p ON p.u = CASE c.u WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE c.u // 4 END
WHERE (c.u % 3 = 0 OR c.u IN (1, 2)) AND c.first_prompt IS NOT NULL AND p.first_tool IS NOT NULL"""
CTES["sc"] = """
SELECT r.capture_id, r.session, start_ts, end_ts,
  CASE WHEN capture_id = 1 THEN 'session-2' WHEN capture_id = 2 THEN 'session-1'
       WHEN capture_id % 4 <> 0 THEN 'session-' || (capture_id // 4) END AS parent_session,
  (SELECT max('role-' || (s.k % 3)) FROM slices s WHERE s.capture_id = r.capture_id AND s.launch) AS child_role,
  CASE WHEN capture_id % 5 = 1 THEN 'helper-' || (capture_id % 2) END AS subagent_type
FROM runs r"""
CTES["parent_candidates"] = """
SELECT c.capture_id, p.capture_id AS parent, 0 AS tier FROM flows f JOIN slices p ON p.id = f.slice_out
  JOIN slices c ON c.id = f.slice_in
WHERE p.kind = 'tool-execution' AND c.name = 'prompt-input' AND p.capture_id <> c.capture_id
UNION
SELECT c.capture_id, p.capture_id, 1 FROM slices l JOIN sc c ON c.session = 'session-' || (l.capture_id + 5)
  JOIN sc p ON p.capture_id = l.capture_id
WHERE l.launch AND c.capture_id <> p.capture_id AND (c.parent_session IS NULL OR c.parent_session = p.session)
  AND c.start_ts BETWEEN p.start_ts AND p.end_ts
UNION
SELECT c.capture_id, p.capture_id, 2 FROM sc c JOIN sc p ON p.session = c.parent_session
WHERE c.capture_id <> p.capture_id AND c.start_ts BETWEEN p.start_ts AND p.end_ts"""
CTES["parents"] = """
SELECT capture_id, min(parent) AS parent_capture_id FROM parent_candidates q
WHERE tier = (SELECT min(tier) FROM parent_candidates b WHERE b.capture_id = q.capture_id)
GROUP BY capture_id HAVING count(DISTINCT parent) = 1"""
CTES["climb"] = """
SELECT capture_id, capture_id AS ancestor FROM sc
UNION
SELECT c.capture_id, p.parent_capture_id FROM climb c JOIN parents p ON p.capture_id = c.ancestor"""
CTES["hier"] = """
SELECT sc.capture_id, coalesce(r.root, sc.capture_id) AS root_capture_id, p.parent_capture_id,
       sc.parent_session IS NOT NULL OR sc.child_role IS NOT NULL OR p.parent_capture_id IS NOT NULL AS is_subagent
FROM sc LEFT JOIN parents p USING (capture_id)
LEFT JOIN (SELECT c.capture_id, min(c.ancestor) AS root FROM climb c LEFT JOIN parents p ON p.capture_id = c.ancestor
           WHERE p.capture_id IS NULL GROUP BY c.capture_id) r ON r.capture_id = sc.capture_id"""
CTES["work"] = """
SELECT capture_id, ts, ts + dur AS end_ts, CASE WHEN kind = 'assistant-message' THEN 1 ELSE 0 END AS models,
       CASE WHEN kind = 'tool-execution' THEN 1 ELSE 0 END AS tools,
       CASE WHEN kind IN ('script', 'model-call') THEN 1 ELSE 0 END AS scripts
FROM slices WHERE NOT incomplete AND dur > 0 AND kind IN ('assistant-message', 'tool-execution', 'script', 'model-call')"""
CTES["points"] = """
SELECT capture_id, ts, models, tools, scripts FROM work
UNION ALL SELECT capture_id, end_ts, -models, -tools, -scripts FROM work"""


def swept(source: str, key: str | None, classes: list[str]) -> str:
    part = f"PARTITION BY {key}" if key else ""
    keys = f"{key}, ts" if key else "ts"
    sums = ", ".join(f"sum({c}) AS {c}" for c in classes)
    opened = ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS {c}" for c in classes)
    return (
        f"SELECT {keys}, lead(ts) OVER w - ts AS dur, {opened} FROM (SELECT {keys}, {sums} FROM {source} GROUP BY {keys})"
        f" WINDOW w AS ({part} ORDER BY ts)"
    )


CTES["seg_all"] = swept("points", None, ["models", "tools", "scripts"])
CTES["seg_capture"] = swept("points", "capture_id", ["models", "tools", "scripts"])
CTES["root_points"] = """
SELECT root_capture_id, ts, models, models + tools + scripts AS active FROM points JOIN hier USING (capture_id)"""
CTES["seg_root"] = swept("root_points", "root_capture_id", ["models", "active"])
CTES["stamps"] = "SELECT CAST(range AS BIGINT) AS n FROM range(48)"

# ------------------------------------------------------------------ captures
FINAL["detected"] = f"""
SELECT {C("category LIKE 'pi.%' OR (kind = 'capture' AND category LIKE '%.metadata')")} AS count FROM slices"""
CTES["all_tracks"] = """
SELECT u AS track_id, u AS capture_id, u // 2 AS upid FROM sess
UNION ALL SELECT -(u * 16 + j), u, u // 2 FROM sess, (VALUES (2), (3), (4), (8), (9), (10), (11), (12), (13), (14)) t(j)
UNION ALL SELECT -(u * 16 + 7), -1 - (u // 2), u // 2 FROM sess"""
FINAL["track_process"] = "SELECT track_id, upid, capture_id FROM all_tracks"
FINAL["counter_tracks"] = (
    "SELECT -(u * 16 + j) AS id, name, display_name, group_name, u AS capture_id FROM sess, (VALUES "
    + ", ".join(
        f"({8 + j}, '{m}', '{d}', {dict(llm='NULL', runtime=repr('Runtime'), tracing=repr('Tracing'))[m.split('.')[0]]})"
        for j, (m, d, _, _) in enumerate(_METRICS)
    )
    + ") t(j, name, display_name, group_name)"
)
FINAL["capture_markers"] = """
SELECT -1000000000000 - u AS slice_id, u AS capture_id, printf('%x', u + 4096) AS recorded_id, 'session-' || u AS session_id,
       CASE WHEN u % 3 <> 0 THEN 'run ' || (u % 3) END AS label FROM sess"""
FINAL["captures"] = """
SELECT u AS capture_id, printf('%x', u + 4096) AS recorded_id, 'session-' || u AS session_id,
       CASE WHEN u % 3 <> 0 THEN 'run ' || (u % 3) END AS label FROM sess"""
CTES["below_marker"] = """
SELECT id, capture_id FROM slices WHERE kind = 'capture'
UNION ALL
SELECT s.id, b.capture_id FROM below_marker b JOIN slices s ON s.parent_id = b.id
WHERE s.kind <> 'capture'
  AND s.track_id IN (SELECT track_id FROM slices WHERE kind = 'capture')"""
FINAL["slice_capture"] = "SELECT id, capture_id FROM below_marker"
FINAL["slices"] = """
SELECT s.id, s.parent_id, s.track_id, s.ts, s.dur, s.name, s.category, s.capture_id, capture, session, kind,
       CAST(incomplete AS INT) AS incomplete, capture_id // 2 AS upid, CASE WHEN capture_id % 8 = 7 THEN capture_id END AS utid,
       CASE WHEN capture_id % 8 = 7 THEN CASE WHEN capture_id % 3 = 0 THEN 'main ' ELSE 'Thread ' END || (capture_id + 100)
            WHEN s.track_id = -(capture_id * 16 + 2) THEN 'tools' ELSE 'agent' END AS track_name
FROM slices s"""
FINAL["kind_rules"] = "SELECT name, category, kind, count(*) AS slices FROM slices GROUP BY ALL"
FINAL["configuration"] = "SELECT * FROM config_known"
FINAL["session_labels"] = """
SELECT u AS capture_id, '["label-' || (u % 4) || '","plan"]' AS session_labels FROM sess WHERE u % 3 = 0"""
_RUN = """capture_id, session, start_ts, end_ts, turns, responses, tools, incomplete, duration_ms, capture, recorded_id, harness,
provider, model, session_labels, effort, context_window_tokens, input_tokens, output_tokens, peak_context, context_share"""
FINAL["capture_runs"] = f"SELECT {_RUN} FROM runs"
FINAL["capture_health"] = """
SELECT track_id, capture_id, name AS metric_key, display_name AS metric, maximum AS value FROM track_maxima
WHERE name IN ('tracing.droppedEvents', 'tracing.laneOverflows')"""
FINAL["inventory"] = f"""
SELECT capture_id, session, capture, harness, provider, model, effort, context_window_tokens, duration_ms AS retained_extent_ms,
       turns AS prompts, responses, tools, incomplete,
       coalesce(measured_responses, 0) AS measured_responses, coalesce(first_content_samples, 0) AS first_content_samples,
       coalesce(output_usage_samples, 0) AS output_usage_samples, coalesce(context_snapshots, 0) AS context_snapshots,
       CAST(2 AS BIGINT) AS runtime_metrics, dropped_events, CAST(NULL AS DOUBLE) AS lane_overflows, queue_depth_peak,
       CASE WHEN capture_id % 2 = 0 THEN capture_id % 3 END AS unavailable_children, CAST(1 AS BIGINT) AS machines,
       (SELECT coalesce({S("event_id % 3")}, 0) FROM events WHERE event_type = 'error' AND event_id % 4 = 0) AS trace_clock_errors
FROM runs LEFT JOIN totals t USING (capture_id) LEFT JOIN (
  SELECT capture_id, {C("NOT incomplete AND message_ns >= 0")} AS measured_responses,
         {C("NOT incomplete AND first_ns >= 0")} AS first_content_samples, count(output_tokens) AS output_usage_samples,
         {C("k % 4 = 1")} AS context_snapshots
  FROM messages GROUP BY capture_id) USING (capture_id)"""

# -------------------------------------------------------------------- models
FINAL["messages"] = """
SELECT id, capture_id, session, ts, dur, name, CAST(incomplete AS INT) AS incomplete, provider, model, timing, message_ns,
       message_start_ts, first_ns, input_tokens, output_tokens, cache_read_tokens FROM messages"""
FINAL["provider_requests"] = """
SELECT id, capture_id, session, ts, dur, name, CASE WHEN NOT incomplete AND dur >= 0 THEN dur / 1e6 END AS request_span_ms,
       'phase-' || (k % 2) AS phase, CAST(incomplete AS INT) AS incomplete, timing FROM slices WHERE kind = 'provider-request'"""
FINAL["models_overview"] = f"""
SELECT provider, model, count(*) AS responses, {S("first_ns")} / count(first_ns) / 1e6 AS first_content_ms,
       count(first_ns) AS latency_samples, {S("message_ns")} / count(message_ns) / 1e6 AS duration_ms,
       {S("input_tokens")} AS input_tokens, {S("output_tokens")} AS output_tokens, {S("cache_read_tokens")} AS cache_read_tokens,
       count(input_tokens) AS input_samples, count(output_tokens) AS output_samples FROM messages GROUP BY ALL"""
CTES["ranked"] = """
SELECT *, row_number() OVER (PARTITION BY capture_id, provider, model, timing ORDER BY message_ns, id) AS r,
       count(*) OVER (PARTITION BY capture_id, provider, model, timing) AS n
FROM messages WHERE NOT incomplete AND message_ns >= 0"""
_RATED = "NOT incomplete AND message_ns > 0 AND output_tokens IS NOT NULL"
FINAL["model_cohorts"] = f"""
SELECT capture_id, provider, model, timing, responses, incomplete, duration_samples, mean_ms, median_ms, p95_ms,
       first_content_mean_ms, first_content_samples, reported_input_tokens, input_samples, reported_output_tokens,
       output_samples, reported_cache_read_tokens, cache_read_samples, output_tokens_per_s, throughput_samples
FROM (SELECT capture_id, provider, model, timing, count(*) AS responses, {C("incomplete")} AS incomplete,
        {C("NOT incomplete AND message_ns >= 0")} AS duration_samples,
        {S("message_ns", "NOT incomplete AND message_ns >= 0")} / {C("NOT incomplete AND message_ns >= 0")} / 1e6 AS mean_ms,
        {S("first_ns", "NOT incomplete AND first_ns >= 0")} / {C("NOT incomplete AND first_ns >= 0")} / 1e6 AS first_content_mean_ms,
        {C("NOT incomplete AND first_ns >= 0")} AS first_content_samples, {S("input_tokens")} AS reported_input_tokens,
        count(input_tokens) AS input_samples, {S("output_tokens")} AS reported_output_tokens, count(output_tokens) AS output_samples,
        {S("cache_read_tokens")} AS reported_cache_read_tokens, count(cache_read_tokens) AS cache_read_samples,
        {S("output_tokens", _RATED)} * CAST(1e9 AS DOUBLE) / {S("message_ns", _RATED)} AS output_tokens_per_s, {C(_RATED)} AS throughput_samples
      FROM messages GROUP BY ALL)
LEFT JOIN (SELECT capture_id, provider, model, timing,
             {S("message_ns", "r IN ((n + 1) // 2, (n + 2) // 2)")} / {C("r IN ((n + 1) // 2, (n + 2) // 2)")} / 1e6 AS median_ms,
             max(message_ns) FILTER (WHERE r = (95 * n + 99) // 100) / 1e6 AS p95_ms FROM ranked GROUP BY ALL)
  USING (capture_id, provider, model, timing)"""

# --------------------------------------------------------------------- tools
_CALL = """id, capture_id, session, ts, dur, name, category, kind, CAST(incomplete AS INT) AS incomplete, call_id, parent_call_id,
is_error, timing, language, line_count, args_truncated"""
FINAL["tool_preflights"] = "SELECT capture_id, call_id, id FROM preflights"
FINAL["tool_calls"] = f"SELECT {_CALL} FROM calls"
FINAL["tool_call_details"] = f"SELECT {_CALL}, intent, arguments FROM calls"
FINAL["script_children"] = "SELECT script_id, id, depth FROM nested"
FINAL["tools_overview"] = f"""
SELECT name AS tool, count(*) AS calls, {S("dur", "NOT incomplete")} / 1e6 AS work_ms,
       max(dur) FILTER (WHERE NOT incomplete) / 1e6 AS longest_ms, {S("CAST(is_error = 1 AS INT)")} AS errors,
       count(is_error) AS outcomes, {C("incomplete")} AS incomplete
FROM calls WHERE kind = 'tool-execution' GROUP BY name"""
FINAL["tool_summary"] = f"""
SELECT capture_id, kind, name AS operation, timing, count(*) AS calls, {C("incomplete")} AS incomplete,
       {C("NOT incomplete AND dur >= 0")} AS duration_samples, {S("dur", "NOT incomplete AND dur >= 0")} / 1e6 AS summed_work_ms,
       max(dur) FILTER (WHERE NOT incomplete AND dur >= 0) / 1e6 AS longest_ms, count(is_error) AS outcome_samples,
       {S("CAST(is_error = 1 AS INT)")} AS errors FROM calls GROUP BY ALL"""
FINAL["scripts"] = """
SELECT id, capture_id, ts, name AS script, CASE WHEN dur >= 0 THEN dur / 1e6 END AS duration_ms, is_error,
       CAST(incomplete AS INT) AS incomplete, intent, arguments, args_truncated, kind, language, line_count,
       (SELECT count(*) FROM nested n WHERE n.script_id = calls.id) AS calls
FROM calls WHERE kind = 'script'"""
FINAL["script_calls"] = """
SELECT script_id, c.id, ts, name AS tool, depth, kind, CASE WHEN dur >= 0 THEN dur / 1e6 END AS duration_ms, is_error,
       CAST(incomplete AS INT) AS incomplete, intent, arguments, args_truncated, language, line_count
FROM nested JOIN calls c USING (id)"""
FINAL["slow_tools"] = """
SELECT id, capture_id, name AS tool, ts, CASE WHEN NOT incomplete AND dur >= 0 THEN dur / 1e6 END AS duration_ms,
       CAST(incomplete AS INT) AS incomplete, is_error, timing
FROM calls WHERE kind = 'tool-execution'
ORDER BY incomplete DESC, CASE WHEN NOT incomplete AND dur >= 0 THEN dur END DESC NULLS LAST, id LIMIT 50"""

# ------------------------------------------------------------------ sessions
FINAL["session_captures"] = """
SELECT capture_id, session, start_ts, end_ts, parent_session,
       CAST(parent_session IS NOT NULL OR child_role IS NOT NULL AS INT) AS is_subagent FROM sc"""
FINAL["capture_parents"] = "SELECT capture_id, parent_capture_id FROM parents"
FINAL["capture_hierarchy"] = "SELECT capture_id, root_capture_id, parent_capture_id, CAST(is_subagent AS INT) AS is_subagent FROM hier"
CTES["downward"] = """
SELECT root_capture_id AS seed, root_capture_id AS capture_id, 0 AS depth FROM hier WHERE root_capture_id = capture_id AND parent_capture_id IS NULL
UNION ALL
SELECT d.seed, p.capture_id, d.depth + 1 FROM downward d JOIN parents p ON p.parent_capture_id = d.capture_id"""
FINAL["capture_descendants"] = "SELECT seed, capture_id, depth FROM downward"
FINAL["workspace_tracks"] = """
SELECT track_id, s.capture_id, s.capture_id // 2 AS upid, CASE WHEN s.capture_id % 8 = 7 THEN s.capture_id END AS utid, s.session,
       any_value(s.capture) AS capture,
       CASE WHEN s.capture_id % 8 = 7 THEN CASE WHEN s.capture_id % 3 = 0 THEN 'main ' ELSE 'Thread ' END || (s.capture_id + 100)
            WHEN track_id = -(s.capture_id * 16 + 2) THEN 'tools' ELSE 'agent' END AS track_name,
       CASE WHEN s.capture_id % 3 <> 0 THEN 'run ' || (s.capture_id % 3) END AS capture_label,
       any_value(p.captures) AS process_captures, CAST(any_value(h.is_subagent) AS INT) AS is_subagent,
       any_value(p.all_subagents) AS all_subagents, any_value(CAST(p.captures = 1 AS INT)) AS single_agent
FROM slices s JOIN hier h USING (capture_id)
JOIN (SELECT capture_id // 2 AS upid, count(DISTINCT capture_id) AS captures, min(CAST(is_subagent AS INT)) AS all_subagents
      FROM hier GROUP BY 1) p ON p.upid = s.capture_id // 2
GROUP BY track_id, s.capture_id, s.session"""
FINAL["delegation"] = """
SELECT c.capture_id, root_capture_id, parent_capture_id, CAST(is_subagent AS INT) AS is_subagent, c.harness, c.start_ts, c.end_ts,
       c.duration_ms AS retained_extent_ms, p.start_ts AS parent_start_ts, p.end_ts AS parent_end_ts,
       CASE WHEN p.start_ts IS NOT NULL THEN greatest(0, least(c.end_ts, p.end_ts) - greatest(c.start_ts, p.start_ts)) / 1e6 END
         AS parent_child_extent_overlap_ms
FROM runs c JOIN hier USING (capture_id) LEFT JOIN runs p ON p.capture_id = parent_capture_id"""
FINAL["child_launches"] = """
SELECT id, capture_id, session, ts, dur, name, CAST(incomplete AS INT) AS incomplete, dur / 1e6 AS launch_duration_ms,
       CASE WHEN NOT incomplete AND dur >= 0 THEN dur / 1e6 END AS launch_lifecycle_ms,
       'session-' || (capture_id + 5) AS child_session, 'role-' || (k % 3) AS child_role, CAST(NULL AS VARCHAR) AS parent_session,
       'x' || id AS correlation FROM slices WHERE launch"""
CTES["first_text"] = """
SELECT capture_id, arg_min(id, (ts, id)) AS prompt_id, arg_min('please do ' || k, (ts, id)) AS prompt_text
FROM slices WHERE name = 'prompt' AND k % 6 <> 0 GROUP BY capture_id"""
CTES["identities"] = """
SELECT capture_id, '[' || string_agg(DISTINCT '{"provider":"' || provider || '","model":"' || model || '"}', ','
       ORDER BY '{"provider":"' || provider || '","model":"' || model || '"}') || ']' AS model_identities
FROM config_known GROUP BY capture_id"""
FINAL["root_sessions"] = f"""
WITH sums AS (
  SELECT root_capture_id AS capture_id, min(start_ts) AS start_ts, (max(end_ts) - min(start_ts)) / 1e6 AS duration_ms,
    {S("turns")} AS turns, {S("responses")} AS responses, {S("tools")} AS tools, {S("incomplete")} AS incomplete,
    sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, max(peak_context) AS peak_context,
    max(context_window_tokens) AS context_window_tokens, max(context_share) AS context_share, count(*) - 1 AS subagents
  FROM runs JOIN hier USING (capture_id) GROUP BY 1),
rates AS (
  SELECT root_capture_id AS capture_id, {S("output_tokens", _RATED)} * CAST(1e9 AS DOUBLE) / {S("message_ns", _RATED)} AS tokens_per_s
  FROM messages JOIN hier USING (capture_id) GROUP BY 1),
busy AS (
  SELECT root_capture_id AS capture_id, {S("dur", "models > 0")} / 1e6 AS model_busy_ms,
         max(models) FILTER (WHERE models > 0 AND dur > 0) AS peak_model_responses
  FROM seg_root GROUP BY 1)
SELECT sums.*, r.session, r.capture, r.recorded_id, r.session_labels, r.harness, r.provider, r.model, r.effort, model_identities,
       prompt_id, prompt_text, tokens_per_s, model_busy_ms, peak_model_responses
FROM sums JOIN runs r USING (capture_id) JOIN identities USING (capture_id) JOIN hier h ON h.capture_id = sums.capture_id
  AND h.root_capture_id = h.capture_id
LEFT JOIN first_text USING (capture_id) LEFT JOIN rates USING (capture_id) LEFT JOIN busy USING (capture_id)"""
FINAL["session_details"] = f"""
WITH rates AS (
  SELECT capture_id, {S("output_tokens", _RATED)} * CAST(1e9 AS DOUBLE) / {S("message_ns", _RATED)} AS tokens_per_s FROM messages GROUP BY 1),
busy AS (
  SELECT capture_id, {S("dur", "models > 0")} / 1e6 AS model_busy_ms,
         max(models) FILTER (WHERE models > 0 AND dur > 0) AS peak_model_responses FROM seg_capture GROUP BY 1)
SELECT capture_id, root_capture_id, parent_capture_id, r.session, capture, recorded_id, prompt_id, prompt_text,
       CAST(is_subagent AS INT) AS is_subagent,
       CASE WHEN NOT is_subagent THEN 'Primary' WHEN subagent_type IS NOT NULL THEN 'Subagent · ' || subagent_type ELSE 'Subagent' END AS role,
       harness, provider, model, model_identities, effort, session_labels, input_tokens, output_tokens, peak_context,
       context_window_tokens, context_share, tokens_per_s, model_busy_ms, peak_model_responses, duration_ms, turns, responses,
       tools, incomplete
FROM runs r JOIN hier USING (capture_id) JOIN identities USING (capture_id)
JOIN (SELECT capture_id, subagent_type FROM sc) USING (capture_id)
LEFT JOIN first_text USING (capture_id) LEFT JOIN rates USING (capture_id) LEFT JOIN busy USING (capture_id)"""
FINAL["flow_pairs"] = f"""
SELECT a.kind AS from_kind, b.kind AS to_kind, count(*) AS flows, {C("a.capture_id <> b.capture_id")} AS across_captures
FROM flows f JOIN slices a ON a.id = f.slice_out JOIN slices b ON b.id = f.slice_in GROUP BY ALL"""

# ------------------------------------------------------------------ activity
FINAL["activity"] = "SELECT ts, dur, models, tools, scripts FROM seg_all"
FINAL["recording_summary"] = f"""
SELECT (SELECT count(DISTINCT root_capture_id) FROM hier) AS sessions,
       (SELECT {C("capture_id <> root_capture_id")} FROM hier) AS subagents,
       (SELECT CAST(count(*) = 1 AS INT) FROM (SELECT provider, model FROM messages UNION SELECT provider, model FROM config)) AS single_model,
       {C("kind = 'prompt'")} AS turns, {C("kind = 'assistant-message'")} AS responses, {C("kind = 'script'")} AS scripts,
       {C("kind = 'tool-execution'")} AS tools, {C("incomplete")} AS incomplete,
       {S("capture_id % 3", "kind = 'capture' AND capture_id % 2 = 0")} AS unavailable_children,
       (max(ts + greatest(dur, 0)) - min(ts)) / 1e6 AS duration_ms,
       (SELECT count(DISTINCT CASE WHEN u % 10 = 0 THEN 1 ELSE 0 END) FROM sess) AS machines,
       (SELECT coalesce({S("event_id % 3")}, 0) FROM events WHERE event_type = 'error' AND event_id % 4 = 0) AS clock_errors
FROM slices"""
FINAL["recording_headline"] = f"""
SELECT (SELECT {S("output_tokens")} * CAST(1e9 AS DOUBLE) / {S("message_ns")} FROM messages WHERE {_RATED}) AS output_tokens_per_s,
       (SELECT {S("dur")} / 1e6 FROM seg_all WHERE dur > 0 AND models > 0) AS model_busy_ms,
       (SELECT max(models) FROM seg_all WHERE dur > 0 AND models > 0) AS peak_model_responses,
       (SELECT (max(ts + greatest(dur, 0)) - min(ts)) / 1e6 FROM slices) AS wall_window_ms"""
FINAL["activity_summary"] = f"""
SELECT {S("dur", "tools > 0 AND models = 0")} / 1e6 AS tools_only_ms, {S("dur", "models > 0 AND tools = 0")} / 1e6 AS models_only_ms,
       {S("dur", "models > 0 AND tools > 0")} / 1e6 AS overlap_ms,
       coalesce({S("dur", "scripts > 0 AND tools = 0 AND models = 0")}, 0) / 1e6 AS scripts_only_ms, max(tools) AS peak_tools,
       {S("dur", "tools > 1")} / 1e6 AS parallel_ms, {S("dur", "tools > 0")} / 1e6 AS tool_active_ms
FROM seg_all WHERE dur > 0"""
FINAL["tool_concurrency_bins"] = """
WITH b AS (SELECT min(ts) AS s, max(ts + dur) - min(ts) AS x FROM seg_all WHERE dur > 0),
w AS (SELECT n, s + x * n // 40 AS w0, s + x * (n + 1) // 40 AS w1, s FROM stamps, b WHERE n < 40)
SELECT n, (w0 - s) / 1e6 AS offset_ms, coalesce(max(a.tools), 0) AS tools
FROM w LEFT JOIN seg_all a ON a.ts < w1 AND a.ts + a.dur > w0 GROUP BY n, w0, s"""


def _held(cond: str) -> str:
    return f"coalesce({S('dur', 'dur > 0 AND ' + cond)}, 0)"


FINAL["capture_occupancy"] = f"""
WITH parts AS (
  SELECT capture_id, min(ts) AS w0, max(ts) AS w1, {_held("models > 0 AND tools = 0")} AS mo, {_held("tools > 0 AND models = 0")} AS tl,
         {_held("models > 0 AND tools > 0")} AS ov, {_held("scripts > 0 AND models = 0 AND tools = 0")} AS so,
         {_held("tools > 1")} AS pa, max(tools) FILTER (WHERE dur > 0) AS pk
  FROM seg_capture GROUP BY capture_id),
x AS (SELECT r.*, greatest(end_ts, w1) - least(start_ts, w0) AS extent, coalesce(mo, 0) AS mo, coalesce(tl, 0) AS tl,
             coalesce(ov, 0) AS ov, coalesce(so, 0) AS so, coalesce(pa, 0) AS pa, coalesce(pk, 0) AS pk
      FROM runs r LEFT JOIN parts USING (capture_id))
SELECT capture_id, session, harness, provider, model, effort, turns AS prompts, responses, tools, incomplete,
       extent / 1e6 AS observed_extent_ms, mo / 1e6 AS model_only_ms, tl / 1e6 AS tool_only_ms, ov / 1e6 AS overlap_ms,
       so / 1e6 AS script_only_ms, greatest(0, extent - mo - tl - ov - so) / 1e6 AS unattributed_ms, pa / 1e6 AS parallel_tool_ms,
       pk AS peak_tools, input_tokens AS reported_input_counter_peak, output_tokens AS reported_output_counter_peak,
       peak_context, context_window_tokens, context_share,
       (SELECT {C("NOT m.incomplete AND message_ns >= 0")} FROM messages m WHERE m.capture_id = x.capture_id) AS measured_responses,
       (SELECT count(m.output_tokens) FROM messages m WHERE m.capture_id = x.capture_id) AS output_usage_samples
FROM x"""


def _bins(bounds: str, segments: str, key: str, active: str) -> str:
    return f"""
WITH b AS ({bounds}),
w AS (SELECT capture_id, n AS bin, start_ts + (end_ts - start_ts) * n // 48 AS w0, start_ts + (end_ts - start_ts) * (n + 1) // 48 AS w1
      FROM b, stamps),
s AS (SELECT {key} AS capture_id, ts, ts + dur AS end_ts FROM {segments} WHERE {active} AND dur > 0)
SELECT w.capture_id, bin, CASE WHEN w.capture_id IN (SELECT {key} FROM {segments}) AND w1 > w0 THEN
       least(1.0, CAST(coalesce({S("greatest(0, least(end_ts, w1) - greatest(ts, w0))", "ts IS NOT NULL")}, 0) AS DOUBLE) / CAST(w1 - w0 AS DOUBLE))
       END AS busy_fraction
FROM w LEFT JOIN s ON s.capture_id = w.capture_id AND s.end_ts > w0 AND s.ts < w1 GROUP BY w.capture_id, bin, w0, w1"""


FINAL["capture_activity_bins"] = _bins(
    "SELECT capture_id, start_ts, end_ts FROM runs", "seg_capture", "capture_id", "models + tools + scripts > 0"
)
FINAL["session_activity_bins"] = _bins(
    "SELECT root_capture_id AS capture_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM runs JOIN hier USING (capture_id) GROUP BY 1",
    "seg_root", "root_capture_id", "active > 0",
)

# ------------------------------------------------------------------- runtime
_UNIT = "CASE WHEN name = 'runtime.cpu' THEN 'us consumed since previous sample' ELSE 'bytes' END AS unit"
FINAL["runtime_summary"] = f"""
SELECT capture_id, track_id, display_name AS metric, {_UNIT}, count(*) AS samples, min(ts) AS first_sample_ts,
       max(ts) AS last_sample_ts, min(value) FILTER (WHERE name = 'runtime.cpu' OR value > 0) AS minimum,
       max(value) FILTER (WHERE name = 'runtime.cpu' OR value > 0) AS maximum,
       CASE WHEN name = 'runtime.cpu' THEN sum(value) END AS sampled_cpu_us
FROM samples WHERE name LIKE 'runtime.%' GROUP BY capture_id, track_id, display_name, name"""
FINAL["runtime_samples"] = f"""
SELECT capture_id, track_id, ts, display_name AS metric, value, {_UNIT} FROM samples WHERE name LIKE 'runtime.%'"""
FINAL["cpu_sample_intervals"] = """
SELECT * FROM (SELECT capture_id, track_id, lag(ts) OVER (PARTITION BY track_id ORDER BY ts) AS start_ts, ts AS end_ts, value AS cpu_us
FROM samples WHERE name = 'runtime.cpu') WHERE start_ts IS NOT NULL"""

CTES["cpu_steps"] = """
SELECT capture_id, track_id, lag(ts) OVER w AS s0, ts AS s1, CAST(value * 1000 AS HUGEINT) AS cpu FROM samples WHERE name = 'runtime.cpu' WINDOW w AS (PARTITION BY track_id ORDER BY ts)"""
FINAL["phase_cpu"] = """
SELECT o.id, o.capture_id, t.track_id, o.kind,
  CAST(coalesce(sum((least(s1, o.start_ts + o.measured_ns) - s0) * cpu // (s1 - s0) - (greatest(s0, o.start_ts) - s0) * cpu // (s1 - s0)) FILTER (WHERE s1 IS NOT NULL), 0) AS BIGINT) AS cpu_ns,
  CAST(coalesce(sum(least(s1, o.start_ts + o.measured_ns) - greatest(s0, o.start_ts)) FILTER (WHERE s1 IS NOT NULL), 0) AS BIGINT) AS covered_ns
FROM ops o JOIN (SELECT DISTINCT capture_id, track_id FROM cpu_steps) t USING (capture_id)
LEFT JOIN cpu_steps c ON c.track_id = t.track_id AND s0 < o.start_ts + o.measured_ns AND s1 > o.start_ts
WHERE o.measured_ns > 0 GROUP BY o.id, o.capture_id, t.track_id, o.kind"""

# --------------------------------------------------------------------- turns
CTES["prompts"] = """
SELECT *, CASE WHEN incomplete THEN least(recorded_end_ts, coalesce(next_start_ts, recorded_end_ts)) ELSE recorded_end_ts END AS attribution_end_ts
FROM (SELECT s.id AS prompt_id, s.capture_id, s.session, s.capture, s.ts AS start_ts, r.start_ts AS capture_start_ts, s.incomplete,
        CASE WHEN s.dur >= 0 THEN s.ts + s.dur ELSE r.end_ts END AS recorded_end_ts,
        lead(s.ts) OVER w AS next_start_ts, row_number() OVER w AS turn_number, s.turn_id AS native_turn_id
      FROM slices s JOIN runs r USING (capture_id) WHERE s.kind = 'prompt'
      WINDOW w AS (PARTITION BY s.capture_id ORDER BY s.ts, s.id))"""
CTES["members"] = """
SELECT *, CAST(sum(CASE WHEN seen IS NULL OR start_ts >= seen THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY start_ts, prompt_id
       ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_id
FROM (SELECT *, max(attribution_end_ts) OVER (PARTITION BY capture_id ORDER BY start_ts, prompt_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM prompts)"""
CTES["clusters"] = """
SELECT capture_id, cluster_id, min(start_ts) AS start_ts, max(attribution_end_ts) AS end_ts, count(*) AS prompts
FROM members GROUP BY ALL"""
CTES["ops"] = """
SELECT s.id, s.capture_id, s.kind, s.incomplete, s.ts AS start_ts,
       CASE WHEN s.incomplete THEN NULL WHEN s.kind = 'assistant-message' THEN m.message_ns WHEN s.dur >= 0 THEN s.dur END AS measured_ns,
       m.provider, m.model, m.input_tokens, m.output_tokens, s.turn_id AS native_turn_id, s.request_id,
       CASE WHEN s.launch THEN 'session-' || (s.capture_id + 5) END AS child_session
FROM slices s LEFT JOIN messages m USING (id)
WHERE s.kind IN ('assistant-message', 'provider-request', 'tool-execution', 'script', 'model-call') OR s.launch"""
CTES["natives"] = """
SELECT capture_id, native_turn_id, min(prompt_id) AS prompt_id FROM prompts WHERE native_turn_id IS NOT NULL
GROUP BY ALL HAVING count(*) = 1"""
CTES["tflows"] = """
SELECT DISTINCT slice_out, slice_in FROM flows
WHERE slice_out IN (SELECT id FROM ops UNION SELECT prompt_id FROM prompts)
   OR slice_in IN (SELECT id FROM ops UNION SELECT prompt_id FROM prompts)"""
CTES["inherited"] = """
SELECT prompt_id AS id, prompt_id, capture_id FROM prompts
UNION ALL
SELECT s.id, i.prompt_id, i.capture_id FROM inherited i JOIN slices s ON s.parent_id = i.id
WHERE s.kind <> 'prompt' AND s.capture_id = i.capture_id
  AND s.track_id IN (SELECT track_id FROM slices WHERE kind = 'prompt')"""
CTES["inside"] = """
SELECT o.id, m.prompt_id, m.start_ts, m.attribution_end_ts,
       max(m.start_ts) OVER (PARTITION BY o.id) AS s1, min(m.attribution_end_ts) OVER (PARTITION BY o.id) AS e1
FROM ops o ASOF JOIN clusters c ON c.capture_id = o.capture_id AND o.start_ts >= c.start_ts
JOIN members m ON m.capture_id = c.capture_id AND m.cluster_id = c.cluster_id
WHERE o.start_ts >= m.start_ts
  AND (o.start_ts < m.attribution_end_ts OR (m.attribution_end_ts = m.start_ts AND o.start_ts = m.start_ts))"""
CTES["owner_candidates"] = """
SELECT o.id, p.prompt_id, 0 AS tier FROM ops o JOIN natives p USING (capture_id, native_turn_id)
UNION SELECT o.id, p.prompt_id, 10 FROM tflows f JOIN prompts p ON p.prompt_id = f.slice_out JOIN ops o ON o.id = f.slice_in AND o.capture_id = p.capture_id
UNION SELECT o.id, p.prompt_id, 20 FROM tflows f JOIN prompts p ON p.prompt_id = f.slice_out JOIN ops x ON x.id = f.slice_in AND x.capture_id = p.capture_id
  JOIN tflows g ON g.slice_out = x.id JOIN ops o ON o.id = g.slice_in AND o.capture_id = p.capture_id
UNION SELECT o.id, i.prompt_id, 100 FROM inherited i JOIN ops o ON o.id = i.id AND o.capture_id = i.capture_id
UNION SELECT id, prompt_id, 1000 FROM inside WHERE start_ts = s1 AND attribution_end_ts = e1"""
CTES["owners"] = """
SELECT id, min(prompt_id) AS prompt_id FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS best FROM owner_candidates)
WHERE tier = best GROUP BY id HAVING count(*) = 1"""
CTES["linked_pairs"] = """
SELECT DISTINCT r.id AS request_slice_id, m.id AS message_slice_id FROM tflows f
JOIN ops r ON r.id IN (f.slice_out, f.slice_in) AND r.kind = 'provider-request'
JOIN ops m ON m.id IN (f.slice_out, f.slice_in) AND m.kind = 'assistant-message' AND m.capture_id = r.capture_id"""
CTES["free_ops"] = """
SELECT * FROM ops WHERE request_id IS NOT NULL AND measured_ns >= 0
  AND id NOT IN (SELECT request_slice_id FROM linked_pairs) AND id NOT IN (SELECT message_slice_id FROM linked_pairs)"""
CTES["overlapping"] = """
SELECT r.id AS request_slice_id, m.id AS message_slice_id FROM free_ops r JOIN free_ops m
  ON m.capture_id = r.capture_id AND m.request_id = r.request_id AND r.kind = 'provider-request' AND m.kind = 'assistant-message'
WHERE (r.measured_ns > 0 AND m.measured_ns > 0 AND r.start_ts < m.start_ts + m.measured_ns AND m.start_ts < r.start_ts + r.measured_ns)
   OR (r.measured_ns = 0 AND m.measured_ns > 0 AND r.start_ts >= m.start_ts AND r.start_ts < m.start_ts + m.measured_ns)
   OR (m.measured_ns = 0 AND r.measured_ns > 0 AND m.start_ts >= r.start_ts AND m.start_ts < r.start_ts + r.measured_ns)
   OR (r.measured_ns = 0 AND m.measured_ns = 0 AND r.start_ts = m.start_ts)"""
CTES["linked"] = """
SELECT request_slice_id AS id FROM linked_pairs UNION
SELECT request_slice_id FROM (SELECT *, count(*) OVER (PARTITION BY request_slice_id) AS a, count(*) OVER (PARTITION BY message_slice_id) AS b
FROM overlapping) WHERE a = 1 AND b = 1"""
CTES["tevents"] = """
SELECT o.*, w.prompt_id, o.start_ts + coalesce(o.measured_ns, 0) AS observed_end_ts
FROM ops o LEFT JOIN owners w USING (id) WHERE o.id NOT IN (SELECT id FROM linked)"""
CTES["tbounds"] = f"""
SELECT p.*, CASE WHEN p.incomplete THEN greatest(p.start_ts, least(p.attribution_end_ts, coalesce(last_seen, p.start_ts)))
            ELSE p.recorded_end_ts END AS display_end_ts, coalesce(events, 0) AS events, model_calls, unmatched_requests, tools,
       unknown_models, unknown_tools, input_tokens, output_tokens, coalesce(ids, '[]') AS model_identities
FROM prompts p LEFT JOIN (
  SELECT prompt_id, count(*) AS events, max(observed_end_ts) AS last_seen, {C("kind = 'assistant-message'")} AS model_calls,
         {C("kind = 'provider-request'")} AS unmatched_requests, {C("kind = 'tool-execution'")} AS tools,
         {C("kind = 'assistant-message' AND (measured_ns IS NULL OR incomplete)")} AS unknown_models,
         {C("kind = 'tool-execution' AND (measured_ns IS NULL OR incomplete)")} AS unknown_tools,
         {S("input_tokens")} AS input_tokens, {S("output_tokens")} AS output_tokens,
         '[' || string_agg(DISTINCT '{{"provider":"' || provider || '","model":"' || model || '"}}', ','
           ORDER BY '{{"provider":"' || provider || '","model":"' || model || '"}}') FILTER (WHERE kind = 'assistant-message') || ']' AS ids
  FROM tevents WHERE prompt_id IS NOT NULL GROUP BY prompt_id) USING (prompt_id)"""
CTES["tspans"] = """
SELECT b.prompt_id, greatest(b.start_ts, e.start_ts) AS ts, least(b.display_end_ts, e.observed_end_ts) AS end_ts,
       CASE WHEN e.kind = 'assistant-message' THEN 1 ELSE 0 END AS models, CASE WHEN e.kind = 'tool-execution' THEN 1 ELSE 0 END AS tools
FROM tbounds b JOIN tevents e USING (prompt_id)
WHERE e.kind IN ('assistant-message', 'tool-execution') AND e.measured_ns > 0 AND NOT e.incomplete
  AND least(b.display_end_ts, e.observed_end_ts) > greatest(b.start_ts, e.start_ts)"""
CTES["tpoints"] = """
SELECT prompt_id, ts, models, tools FROM tspans UNION ALL SELECT prompt_id, end_ts, -models, -tools FROM tspans"""
CTES["seg_turn"] = swept("tpoints", "prompt_id", ["models", "tools"])
CTES["tsplit"] = f"""
SELECT prompt_id, {_held("models > 0 AND tools = 0")} AS models_only_ns, {_held("tools > 0 AND models = 0")} AS tools_only_ns,
       {_held("models > 0 AND tools > 0")} AS overlap_ns FROM seg_turn WHERE dur > 0 GROUP BY prompt_id"""
CTES["tturns"] = """
SELECT b.*, coalesce(models_only_ns, 0) AS models_only_ns, coalesce(tools_only_ns, 0) AS tools_only_ns, coalesce(overlap_ns, 0) AS overlap_ns,
       greatest(0, display_end_ts - start_ts - coalesce(models_only_ns, 0) - coalesce(tools_only_ns, 0) - coalesce(overlap_ns, 0)) AS unattributed_ns
FROM tbounds b LEFT JOIN tsplit USING (prompt_id)"""


def _ints(columns: str) -> str:
    return columns.replace("incomplete,", "CAST(incomplete AS INT) AS incomplete,")


_PROMPT = _ints(
    "prompt_id, capture_id, session, capture, start_ts, capture_start_ts, incomplete, recorded_end_ts, next_start_ts, turn_number,"
    " native_turn_id, attribution_end_ts"
)
_OP = _ints(
    "id, capture_id, kind, incomplete, start_ts, measured_ns, provider, model, input_tokens, output_tokens, native_turn_id,"
    " request_id, child_session"
)
_BOUND = (
    _PROMPT + ", display_end_ts, events, model_calls, unmatched_requests, tools, unknown_models, unknown_tools, input_tokens,"
    " output_tokens, model_identities"
)
_TURN = _BOUND + ", models_only_ns, tools_only_ns, overlap_ns, unattributed_ns"
FINAL["turn_prompts"] = f"SELECT {_PROMPT} FROM prompts"
FINAL["prompt_clusters"] = "SELECT * FROM clusters"
FINAL["turn_work"] = f"SELECT {_OP} FROM ops"
FINAL["native_prompts"] = "SELECT * FROM natives"
FINAL["turn_flows"] = "SELECT * FROM tflows"
FINAL["prompt_ancestry"] = "SELECT id, prompt_id, capture_id FROM inherited"
FINAL["turn_owners"] = "SELECT id, prompt_id FROM owners"
FINAL["explicit_requests"] = "SELECT * FROM linked_pairs"
FINAL["request_matches"] = "SELECT request_slice_id, message_slice_id FROM overlapping"
FINAL["request_match_counts"] = """
SELECT request_slice_id AS id, 'provider-request' AS kind, count(*) AS overlaps,
       CASE WHEN count(*) = 1 THEN min(message_slice_id) END AS only_id FROM overlapping GROUP BY 1
UNION ALL
SELECT message_slice_id, 'assistant-message', count(*), CASE WHEN count(*) = 1 THEN min(request_slice_id) END FROM overlapping GROUP BY 1"""
FINAL["linked_requests"] = "SELECT id FROM linked"
FINAL["turn_events"] = f"SELECT {_OP}, prompt_id, observed_end_ts FROM tevents"
FINAL["turn_bounds"] = f"SELECT {_BOUND} FROM tbounds"
FINAL["turn_activity"] = "SELECT * FROM tsplit"
FINAL["turns"] = f"SELECT {_TURN} FROM tturns"
FINAL["turns_with_prompts"] = f"""
SELECT {_TURN}, prompt_text FROM tturns
JOIN (SELECT id AS prompt_id, CASE WHEN k % 6 <> 0 THEN 'please do ' || k END AS prompt_text FROM slices) USING (prompt_id)"""
FINAL["turn_unassigned"] = f"""
SELECT capture_id, kind, count(*) AS unassigned_events, {C("incomplete OR measured_ns IS NULL")} AS unknown_or_incomplete
FROM tevents WHERE prompt_id IS NULL GROUP BY ALL"""
FINAL["turn_unassigned_totals"] = f"""
SELECT count(*) AS events, {C("kind = 'assistant-message'")} AS responses, {C("kind = 'tool-execution'")} AS tools
FROM tevents WHERE prompt_id IS NULL"""
FINAL["turn_waterfall"] = f"""
WITH pick AS (SELECT arg_min(prompt_id, (-events, prompt_id)) AS target FROM tbounds),
mine AS (SELECT *, count(*) OVER () AS total_events FROM tevents, pick WHERE prompt_id = target),
kids AS (SELECT session AS child_session, min(prompt_id) AS child_prompt_id FROM prompts GROUP BY session HAVING count(DISTINCT capture_id) = 1)
SELECT m.id, m.capture_id, m.kind, CAST(m.incomplete AS INT) AS incomplete, m.start_ts, m.measured_ns, m.provider, m.model, m.input_tokens,
       m.output_tokens, m.native_turn_id, m.request_id, m.child_session, m.prompt_id, m.observed_end_ts, m.total_events, s.name,
       c.intent, c.arguments, c.args_truncated, c.language, c.line_count, c.call_id, c.parent_call_id, c.is_error,
       g.first_ns / 1e6 AS first_content_ms, child_prompt_id,
       (SELECT count(*) FROM nested n WHERE n.id = m.id AND n.script_id IN (SELECT id FROM mine)) AS depth
FROM mine m JOIN slices s USING (id) LEFT JOIN calls c USING (id)
LEFT JOIN messages g USING (id) LEFT JOIN kids USING (child_session)"""
FINAL["sql_turn_waterfall"] = FINAL["turn_waterfall"]
FINAL["sql_usage"] = """
SELECT harness, model, count(*) AS captures, CAST(sum(coalesce(n, 0)) AS BIGINT) AS calls, max(coalesce(names, 0)) AS most_tools, CAST(sum(coalesce(prompts, 0)) AS BIGINT) AS prompts,
       max(longest_ns) AS longest_ns, count(*) FILTER (WHERE incomplete > 0) AS with_open_work
FROM runs LEFT JOIN (SELECT capture_id, count(*) AS n, count(DISTINCT name) AS names FROM calls GROUP BY 1) USING (capture_id)
LEFT JOIN (SELECT capture_id, count(*) AS prompts, max(display_end_ts - start_ts) AS longest_ns FROM tturns GROUP BY 1) USING (capture_id) GROUP BY 1, 2"""
FINAL["turns_page"] = f"""
SELECT {_TURN}, row_number() OVER (ORDER BY start_ts, prompt_id) AS position, count(*) OVER () AS total_turns
FROM tturns QUALIFY position <= 200"""
FINAL["slowest_turns"] = """
SELECT prompt_id, capture_id, session, turn_number, CAST(incomplete AS INT) AS incomplete, start_ts,
       (display_end_ts - start_ts) / 1e6 AS observed_extent_ms, models_only_ns / 1e6 AS models_only_ms, tools_only_ns / 1e6 AS tools_only_ms,
       overlap_ns / 1e6 AS overlap_ms, unattributed_ns / 1e6 AS unattributed_ms, events, model_calls, unmatched_requests, tools,
       unknown_models, unknown_tools
FROM tturns ORDER BY display_end_ts - start_ts DESC NULLS LAST, prompt_id LIMIT 20"""

# ------------------------------------------------------------------- context
CTES["snaps"] = """
SELECT id AS event_id, capture_id, session, ts + CASE WHEN k % 3 = 0 THEN 1000 ELSE 0 END AS ts, 'request' AS stage,
       'estimate-' || (k % 2 + capture_id % 2) AS basis, 'complete' AS coverage, CASE WHEN k % 16 = 1 THEN 1 ELSE 0 END AS baseline,
       'model-' || (k % 3) AS model, k * 20 AS estimated_tokens, CASE WHEN k % 3 <> 0 THEN k * 21 END AS reported_tokens,
       CAST(200000 AS BIGINT) AS window_tokens, CAST(NULL AS BIGINT) AS effective_window_tokens,
       CAST(NULL AS BIGINT) AS compact_threshold_tokens, CAST(0 AS BIGINT) AS omitted_changes, k, cents, prev_id,
       '{"prompts":' || k || ',"results":' || (cents % 100) || '}' AS categories
FROM slices WHERE kind = 'assistant-message' AND k % 4 = 1"""
_SNAP = """event_id, capture_id, session, ts, stage, basis, coverage, baseline, model, estimated_tokens, reported_tokens,
window_tokens, effective_window_tokens, compact_threshold_tokens, omitted_changes, categories"""
CTES["items"] = """
WITH m AS (SELECT *, CASE WHEN baseline = 0 AND basis = lag(basis) OVER w THEN lag(estimated_tokens) OVER w END AS previous_estimated_tokens
           FROM snaps WINDOW w AS (PARTITION BY capture_id ORDER BY ts, event_id)),
i AS (
  SELECT *, 'item-' || (k % 9) AS item_id, 'results' AS category, 'added' AS change, k * 3 AS tokens, k * 3 AS delta_tokens, k * 12 AS chars,
         coalesce('c' || prev_id, '') AS source_id, 'tool' AS source_kind, 'result ' || k AS label FROM m
  UNION ALL
  SELECT *, 'prompt-' || (k % 5), 'prompts', 'removed', 0, -k, 0, '', 'message', 'prompt ' || k FROM m)
SELECT event_id AS snapshot_id, i.capture_id, i.session, i.ts, CASE WHEN k % 8 = 1 THEN 'response' ELSE stage END AS stage, basis, baseline,
       estimated_tokens, reported_tokens, previous_estimated_tokens, item_id, i.category, change, tokens, delta_tokens, chars, source_id,
       source_kind, coalesce(c.id, event_id) AS event_id, c.name AS tool, label
FROM i LEFT JOIN calls c ON c.capture_id = i.capture_id AND c.call_id = i.source_id"""
_ITEM = """snapshot_id, capture_id, session, ts, stage, basis, baseline, estimated_tokens, reported_tokens, previous_estimated_tokens,
item_id, category, change, tokens, delta_tokens, chars, source_id, source_kind, event_id, tool"""
CTES["latest"] = "SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY ts DESC, event_id DESC) = 1"
FINAL["context_snapshots"] = f"SELECT {_SNAP} FROM snaps"
FINAL["context_changes"] = f"SELECT {_ITEM} FROM items"
FINAL["context_change_details"] = f"SELECT {_ITEM}, label FROM items"
_SNAP_S = ", ".join("s." + c.strip() for c in _SNAP.split(","))
FINAL["context_latest"] = f"""
SELECT {_SNAP_S}, root_capture_id, harness FROM latest s JOIN hier USING (capture_id) JOIN runs r USING (capture_id)"""
FINAL["context_observations"] = f"""
SELECT {_SNAP_S}, root_capture_id, harness FROM snaps s JOIN hier USING (capture_id) JOIN runs r USING (capture_id)"""
FINAL["context_summary"] = """
SELECT r.capture_id, peak_context, context_window_tokens, context_share, event_id AS latest_snapshot_id, s.ts AS latest_snapshot_ts,
       stage, basis, coverage, s.model AS snapshot_model, estimated_tokens, reported_tokens, window_tokens, effective_window_tokens,
       compact_threshold_tokens, omitted_changes, categories,
       (SELECT count(*) FROM snaps x WHERE x.capture_id = r.capture_id) AS snapshots,
       (SELECT count(*) FROM items x WHERE x.capture_id = r.capture_id) AS retained_changes
FROM runs r LEFT JOIN latest s USING (capture_id)"""
FINAL["context_history"] = """
SELECT c.ts, value AS tokens, capture_id, root_capture_id, r.session, context_window_tokens AS window_tokens
FROM samples c JOIN hier USING (capture_id) JOIN runs r USING (capture_id)
WHERE c.name = 'llm.context.estimated_tokens' AND c.ts < r.end_ts"""
FINAL["compactions"] = """
SELECT id AS event_id, capture_id, ts, dur, CAST(incomplete AS INT) AS incomplete,
       CASE WHEN NOT incomplete AND dur >= 0 THEN dur / 1e6 END AS duration_ms, k * 50 AS before_tokens,
       CASE WHEN k % 3 <> 0 THEN k * 10 END AS after_tokens FROM slices WHERE kind = 'compaction'"""
FINAL["top_context_changes"] = f"""
SELECT {_ITEM} FROM items ORDER BY abs(delta_tokens) DESC, ts, snapshot_id, item_id LIMIT 50"""
FINAL["category_shares"] = f"""
WITH c AS (SELECT 'prompts' AS category, k AS tokens FROM latest UNION ALL SELECT 'results', cents % 100 FROM latest)
SELECT category, count(*) AS sessions, {S("tokens")} AS tokens,
       {S("tokens")} / (SELECT {S("tokens")} FROM c) AS share FROM c GROUP BY category"""


_WORD = re.compile(r"[a-z_0-9]+")


def _needs(sql: str, own: str | None = None) -> list[str]:
    """CTEs a statement needs, dependencies first."""
    order: list[str] = []

    def visit(text: str, me: str | None) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in CTES and word != me and word not in order:
                visit(CTES[word], word)
                order.append(word)

    visit(sql, own)
    return order


def sql_for(name: str) -> str:
    body = FINAL[name].strip()
    local = set(re.findall(r"(?:WITH|,)\s*([a-z_]+) AS \(", body)) if body.startswith("WITH") else set()
    parts = [f"{c} AS ({CTES[c].strip()})" for c in _needs(body) if c not in local]
    if body.startswith("WITH"):
        body = "SELECT * FROM (" + body + ")"
    if not parts:
        return body
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def oracle() -> dict[str, str]:
    from checks import oracle_ingest  # noqa: F401  (adds its statements)

    return {name: sql_for(name) for name in FINAL}
