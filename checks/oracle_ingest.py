"""SQL of the ingest, item-set and comparison queries."""

from __future__ import annotations

from checks.oracle import CTES, FINAL, C, S, swept

SES = "'session-' || u AS session"
CTES["bounds_u"] = "SELECT u, min(ns) AS first_ns, max(ns) AS last_ns FROM ev0 GROUP BY u"
CTES["uuids"] = """
SELECT u, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS uuid
FROM (SELECT u, md5(CAST(u AS VARCHAR)) AS m FROM bounds_u)"""

# ------------------------------------------------------------------ journals
FINAL["parse_observations"] = """
SELECT u AS recording, id AS seq, CAST(k % 13 > 4 AS INT) AS valid, CASE WHEN k % 13 > 4 THEN typ END AS source,
       CASE WHEN k % 13 > 4 THEN ns END AS timestamp, CASE WHEN k % 13 > 4 THEN '{"cents":' || cents || ',"k":' || k || '}' END AS data
FROM ev0"""
CTES["chunks"] = """
SELECT u, id % 3 AS chunk, count(*) FILTER (k % 13 <= 4) + CASE WHEN u % 7 = 0 THEN 1 ELSE 0 END AS bad, arg_max(ns, id) FILTER (k % 13 > 4) AS last_ns FROM ev0 GROUP BY u, id % 3"""
FINAL["read_journal"] = f"""
SELECT u AS recording, rows, coalesce(corrupt, 0)::BIGINT AS corrupt, damaged_chunks, clocks
FROM (SELECT u, {C('k % 13 > 4')} AS rows, (sum(ns::HUGEINT) FILTER (k % 13 > 4) % 1000000007)::BIGINT AS clocks FROM ev0 GROUP BY u)
JOIN (SELECT u, sum(bad) AS corrupt, {C('bad > 0')} AS damaged_chunks FROM chunks GROUP BY u) USING (u)"""
FINAL["read_chunked_journal"] = """
SELECT u AS recording, id % 3 AS chunk, typ AS source, ns AS timestamp, '{"cents":' || cents || ',"k":' || k || '}' AS data FROM ev0 WHERE k % 13 > 4
UNION ALL
SELECT u, chunk, 'recovery', last_ns, '{"incomplete_chunk":"events-' || chunk || '.jsonl","corrupt_records":' || bad || '}' FROM chunks WHERE bad > 0
UNION ALL SELECT u, -1, 'process_start', first_ns, '{"pid":' || u || '}' FROM bounds_u
UNION ALL SELECT u, -1, 'clock_snapshot', first_ns, '{}' FROM bounds_u"""
# one row per operation: its scope, name, bounds (end null while open) and what the recorder said
CTES["mod_last"] = """
SELECT u, CASE WHEN u % 3 = 0 THEN max(last_ns) + 10000000000000 ELSE max(t) END AS capture_end FROM (
  SELECT u, greatest(ns + CASE WHEN typ = 'signup' AND k % 4 <> 0 THEN cents * 40000000000 WHEN typ = 'view' AND k % 4 <> 0 THEN cents * 1000000
    WHEN typ = 'click' THEN cents * 1000000 + CASE WHEN k % 4 <> 0 THEN 2000000 ELSE 0 END WHEN typ = 'purchase' AND k % 4 <> 0 THEN cents * 1000
    WHEN typ = 'error' THEN CASE WHEN k % 4 <> 0 THEN 7000 WHEN k % 2 = 0 THEN 6000 ELSE 5000 END ELSE 0 END, ns) AS t FROM ev0) JOIN bounds_u USING (u) GROUP BY u"""
CTES["mod_root"] = """
SELECT u, first_ns AS t0, greatest(max(ns + CASE typ WHEN 'click' THEN cents * 1000000 + CASE WHEN k % 4 <> 0 THEN 2000000 ELSE 0 END ELSE
    CASE WHEN k % 4 = 0 THEN 0 WHEN typ = 'signup' THEN cents * 40000000000 WHEN typ = 'view' THEN cents * 1000000 WHEN typ = 'purchase' THEN cents * 1000 ELSE 7000 END END),
  CASE WHEN bool_or(k % 4 = 0) OR u % 3 = 0 THEN any_value(capture_end) ELSE 0 END) AS t1
FROM ev0 JOIN bounds_u USING (u) JOIN mod_last USING (u) GROUP BY u, first_ns"""
CTES["mod_child"] = """
SELECT u, id, k, ns + 1000 AS t0, CASE WHEN k % 2 = 0 THEN ns + 6000 ELSE capture_end END AS t1 FROM ev0 JOIN mod_last USING (u) WHERE typ = 'error'"""
CTES["mod_prompts"] = """
SELECT u, 'session-' || u AS scope, id, ns AS t0, CASE WHEN k % 4 <> 0 THEN ns + cents * 40000000000 ELSE capture_end END AS t1, k % 4 = 0 AS cut, 'please ' || k AS said
FROM ev0 JOIN mod_last USING (u) WHERE typ = 'signup'
UNION ALL SELECT u, 'session-' || u || '/w' || id, id, t0, t1, k % 2 <> 0, 'verify' FROM mod_child"""
CTES["mod_responses"] = """
SELECT u, 'session-' || u AS scope, id, ns AS t0, CASE WHEN k % 4 <> 0 THEN ns + cents * 1000000 ELSE capture_end END AS t1, k % 4 = 0 AS cut, 'm' || (k % 3) AS model,
  CASE WHEN k % 4 <> 0 AND k % 7 <> 0 THEN k * 100 END AS i, CASE WHEN k % 4 <> 0 THEN k * 10 END AS o, CASE WHEN k % 4 <> 0 AND k % 7 <> 0 AND k % 2 = 0 THEN k * 101 + 3 END AS size
FROM ev0 JOIN mod_last USING (u) WHERE typ = 'view'
UNION ALL SELECT u, 'session-' || u || '/w' || id, id, ns + 2000, ns + 5000, false, 'child', 4, 7, NULL FROM ev0 WHERE typ = 'error'"""
CTES["mod_tools"] = """
SELECT *, CASE WHEN fits THEN run - took ELSE t0 END AS s0, CASE WHEN fits THEN run ELSE t1 END AS s1 FROM (
  SELECT *, coalesce(run <= t1 AND took <= t1 - t0 + 1000000, false) AS fits FROM (
    SELECT u, 'session-' || u AS scope, id, ns AS t0, typ, k,
      CASE WHEN k % 4 = 0 THEN capture_end WHEN typ = 'click' THEN ns + cents * 1000000 + 2000000 ELSE ns + 7000 END AS t1, k % 4 = 0 AS cut,
      CASE WHEN typ = 'click' THEN ns + cents * 1000000 END AS run, CASE WHEN typ = 'click' THEN CASE WHEN k % 3 = 0 THEN cents * 1000000 + 5000000 ELSE cents * 500000 END END AS took,
      CASE WHEN typ = 'click' THEN 'Bash' ELSE 'Agent' END AS name, CASE WHEN typ = 'error' THEN 'session-' || u || '/w' || id END AS child,
      CASE WHEN typ = 'click' THEN CAST(k % 5 = 0 AS INT) WHEN k % 4 <> 0 THEN 0 END AS err
    FROM ev0 JOIN mod_last USING (u) WHERE typ IN ('click', 'error')))"""
CTES["mod_compactions"] = """
SELECT u, 'session-' || u AS scope, ns AS t0, CASE WHEN k % 4 <> 0 THEN ns + cents * 1000 ELSE capture_end END AS t1, k % 4 = 0 AS cut, CASE WHEN k % 2 = 0 THEN 'precompute' ELSE 'compact' END AS name,
  CASE WHEN k % 4 <> 0 THEN k * 50 END AS before, CASE WHEN k % 4 <> 0 AND k % 3 <> 0 THEN k * 10 END AS after
FROM ev0 JOIN mod_last USING (u) WHERE typ = 'purchase'"""
CTES["mod_scopes"] = """
SELECT 'session-' || u AS scope, t0, t1, u % 3 <> 0 OR u % 2 = 1 AS cut, 'm' || (u % 3) AS model, CAST(NULL AS VARCHAR) AS parent FROM mod_root
UNION ALL SELECT 'session-' || u || '/w' || id, t0, t1, k % 2 <> 0, 'child', 'session-' || u FROM mod_child"""
FINAL["ingest_journals"] = """
SELECT 'slice' AS part, scope, 'Session:profile (1)' AS name, t0 AS ts, t1 - t0 AS value, concat_ws('/', 'capture', CASE WHEN cut THEN 1 END, model, 'mod-hooks', parent) AS detail FROM mod_scopes
UNION ALL SELECT 'slice', scope, 'Inputs:prompt-input', t0, 0, 'prompt-input' FROM mod_prompts
UNION ALL SELECT 'slice', scope, 'Session:prompt', t0, t1 - t0, concat_ws('/', 'prompt', CASE WHEN cut THEN 1 END, said) FROM mod_prompts
UNION ALL SELECT 'slice', scope, 'Responses:response', t0, t1 - t0, concat_ws('/', 'assistant-message', CASE WHEN cut THEN 1 END, model, 'mod-request-including-retries') FROM mod_responses
UNION ALL SELECT 'slice', scope, 'Turns:turn', t0, t1 - t0, concat_ws('/', 'turn', CASE WHEN cut THEN 1 END) FROM mod_responses
UNION ALL SELECT 'slice', scope, 'Tools:' || name, s0, s1 - s0, concat_ws('/', 'tool-execution', CASE WHEN cut OR NOT fits THEN 1 END,
  CASE WHEN fits THEN 'reported-execution-duration' ELSE 'dispatch-only' END, child, err) FROM mod_tools
UNION ALL SELECT 'slice', scope, 'Tool dispatch:' || name, t0, t1 - t0, concat_ws('/', 'tool-dispatch', CASE WHEN cut THEN 1 END, 'including-permissions-and-hooks') FROM mod_tools
UNION ALL SELECT 'slice', scope, 'Compaction:' || name, t0, t1 - t0, concat_ws('/', 'compaction', CASE WHEN cut THEN 1 END, 'mod-compaction') FROM mod_compactions
UNION ALL SELECT 'counter', scope, 'llm.tokens.input', t1, CAST(sum(i) OVER (PARTITION BY scope ORDER BY t1, id) AS BIGINT), NULL FROM mod_responses WHERE i IS NOT NULL
UNION ALL SELECT 'counter', scope, 'llm.tokens.output', t1, CAST(sum(o) OVER (PARTITION BY scope ORDER BY t1, id) AS BIGINT), NULL FROM mod_responses WHERE o IS NOT NULL
UNION ALL SELECT 'counter', scope, 'llm.tokens.' || n, t, 0, NULL FROM (SELECT scope, t0 AS t FROM mod_scopes UNION ALL SELECT scope, t1 FROM mod_scopes), (VALUES ('input'), ('output')) v(n)
UNION ALL SELECT 'counter', scope, 'llm.context.estimated_tokens', t1, size, NULL FROM mod_responses WHERE size IS NOT NULL
UNION ALL SELECT 'counter', scope, 'llm.context.estimated_tokens', t0, before, NULL FROM mod_compactions WHERE before IS NOT NULL
UNION ALL SELECT 'counter', scope, 'llm.context.estimated_tokens', t1, coalesce(after, 0), NULL FROM mod_compactions WHERE NOT cut OR after IS NOT NULL
UNION ALL SELECT 'flow', scope, 'Inputs:prompt-input>Session:prompt', t0, t0, scope FROM mod_prompts
UNION ALL SELECT 'flow', r.scope, 'Session:prompt>Responses:response', arg_min(p.t0, (p.t0, p.id)), r.t0, r.scope FROM mod_responses r JOIN mod_prompts p ON p.scope = r.scope AND r.t0 BETWEEN p.t0 AND p.t1
  GROUP BY r.scope, r.id, r.t0
UNION ALL SELECT 'flow', scope, 'Tool dispatch:' || name || '>Tools:' || name, t0, s0, scope FROM mod_tools WHERE s0 >= t0
UNION ALL SELECT 'flow', t.scope, 'Responses:response>Tools:' || t.name, r.t0, t.s0, t.scope FROM mod_tools t ASOF JOIN mod_responses r ON r.scope = t.scope AND t.t0 >= r.t0 WHERE t.s0 >= r.t0
UNION ALL SELECT 'flow', scope, CASE WHEN s0 <= t0 + 1000 THEN 'Tools:Agent' ELSE 'Tool dispatch:Agent' END || '>Inputs:prompt-input', CASE WHEN s0 <= t0 + 1000 THEN s0 ELSE t0 END, t0 + 1000, child
  FROM mod_tools WHERE name = 'Agent'"""
CTES["own_spans"] = """
SELECT u, id, 's' || id AS span_id, id AS seq, 0 AS pos, CASE WHEN k % 4 <> 0 THEN 's' || prev_id END AS parent_span_id, typ AS name,
       ns AS start_ns, CASE WHEN k % 10 = 9 THEN ns - 1 ELSE ns + cents * 1000 END AS end_ns, CAST(k % 8 = 0 AS INT) AS is_error,
       'session-' || u AS session, CASE WHEN k >= 5 THEN CAST(k - 5 AS VARCHAR) END AS n, 'true' AS ok, '0.5' AS n2
FROM ev"""
CTES["all_spans"] = """
SELECT * FROM own_spans WHERE end_ns >= start_ns
UNION ALL
SELECT u, prev_id, 's' || prev_id, id, 1, NULL, 'resent', ns - 1000, ns, 0, NULL, NULL, NULL, NULL
FROM ev WHERE k % 5 = 0 AND prev_id IS NOT NULL"""
CTES["last_spans"] = "SELECT * FROM all_spans QUALIFY row_number() OVER (PARTITION BY u, span_id ORDER BY seq DESC, pos DESC) = 1"
FINAL["flatten_otlp_spans"] = """
SELECT u AS recording, 't' || u AS trace_id, span_id, parent_span_id, name, start_ns, end_ns, is_error, session, n, ok, n2 FROM last_spans"""
FINAL["otel_attributes"] = """
SELECT 'session.id' AS key, count(session) AS spans, min(session) AS low, max(session) AS high FROM last_spans
UNION ALL SELECT 'n', count(n), min(n), max(n) FROM last_spans
UNION ALL SELECT 'ok', count(ok), min(ok), max(ok) FROM last_spans
UNION ALL SELECT 'n2', count(n2), min(n2), max(n2) FROM last_spans"""
FINAL["flatten_otlp_logs"] = """
SELECT u AS recording, 't' || u AS trace_id, CASE WHEN k % 4 = 0 THEN ns // 1000000 * 1000000 ELSE ns END AS at_ns, typ AS event_name,
       uuid AS conversation FROM ev0 JOIN uuids USING (u) GROUP BY ALL"""
FINAL["captured_session_ids"] = """
SELECT DISTINCT u AS recording, uuid AS session FROM ev0 JOIN uuids USING (u) WHERE typ <> 'signup'
UNION
SELECT DISTINCT u, substr(uuid, 1, 24) || lpad(CAST(k AS VARCHAR), 12, '0') FROM ev0 JOIN uuids USING (u)
WHERE typ = 'signup' AND k % 2 = 0 AND k % 3 <> 0"""
FINAL["flatten_session_export"] = """
SELECT 'x' || id AS session, 'x' || id AS record_id, ns // 1000 * 1000 AS at_ns, 'run' AS family, 'model_completed' AS kind, 'r' || k AS run,
       CAST(NULL AS VARCHAR) AS task, CAST(NULL AS VARCHAR) AS child_session, '{"duration_ms":"' || k || '","model":"m"}' AS fields
FROM ev0
UNION ALL
SELECT 'x' || id, 'z' || id, ns // 1000 * 1000, 'run', 'cancelled', 'r' || k, NULL, NULL, '{"reason":"user"}' FROM ev0"""
FINAL["export_diagnostics"] = """
SELECT 'x' || id AS session, CAST(k % 2 AS BIGINT) AS gaps, CAST(1 - k % 2 AS BIGINT) AS omitted_live_only FROM ev0"""
FINAL["read_transcripts"] = """
SELECT CAST(conv_id AS VARCHAR) AS file, turn AS seq,
       CASE WHEN turn = 0 OR (turn = 3 AND conv_id % 2 = 0) THEN 'session_meta' WHEN turn = 4 THEN 'token_usage_record' ELSE 'response_item' END AS type
FROM conversations
WHERE CASE WHEN turn >= 4 THEN conv_id % 3 = 0 ELSE turn < 3 OR conv_id % 2 = 1 END"""

# ------------------------------------------------------------------- pairing
FINAL["pair_begin_end"] = """
WITH p AS (
  SELECT u, typ, id % 3 AS id, ns AS ts, 0 AS side, 1 AS step FROM ev0
  UNION SELECT u, typ, id % 3, ns + cents * 40000000000, 1, -1 FROM ev0 WHERE k % 4 <> 0),
s AS (SELECT *, sum(step) OVER w AS height, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY u, typ, id ORDER BY ts, side)),
m AS (
  SELECT b.u, b.typ, b.id, b.ts, b.n, arg_min(e.ts, e.n) AS own_end FROM s b LEFT JOIN s e
    ON e.u = b.u AND e.typ = b.typ AND e.id = b.id AND e.step = -1 AND e.n > b.n AND e.height = b.height - 1
  WHERE b.step = 1 GROUP BY ALL)
SELECT 's' || u AS scope, typ AS event, id, ts AS start_ts,
       greatest(ts, coalesce(own_end, CASE WHEN u % 3 = 0 THEN last_ns + 1 END, last_seen)) AS end_ts, CAST(own_end IS NULL AS INT) AS incomplete
FROM m JOIN bounds_u USING (u) JOIN (SELECT u, max(ts) AS last_seen FROM p GROUP BY u) USING (u)"""
FINAL["pair_hook_dispatch"] = f"""
SELECT {SES}, 'tool-execution' AS kind, 'c' || id AS call_id, CASE WHEN k % 2 = 0 THEN 'bash' ELSE 'read' END AS name, ns AS start_ts,
       CASE WHEN k % 4 <> 0 THEN ns + cents * 1000 ELSE 2000000000000000000 END AS end_ts, CAST(k % 4 = 0 AS INT) AS incomplete,
       CASE WHEN k % 4 <> 0 AND k % 2 = 0 THEN k % 3 END AS exit_code,
       CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN CAST(k % 3 <> 0 AS INT) WHEN k % 7 <> 0 THEN CAST(k % 5 = 0 AS INT) END AS is_error
FROM ev0 WHERE typ = 'click' AND k % 6 <> 0
UNION ALL
SELECT session, 'compaction', NULL, 'compaction', ns, CASE WHEN next_odd = 1 THEN next_ns ELSE 2000000000000000000 END,
       CAST(coalesce(next_odd, 3) <> 1 AS INT), NULL, NULL
FROM (SELECT {SES}, ns, k % 4 AS odd, lead(k % 4) OVER w AS next_odd, lead(ns) OVER w AS next_ns FROM ev0 WHERE typ = 'purchase' AND k % 2 = 1
      WINDOW w AS (PARTITION BY u ORDER BY ns)) WHERE odd = 3"""
FINAL["place_reported_duration"] = """
SELECT id, ns + cents * 100000 AS end_ts, CASE WHEN fits THEN ns + cents * 100000 - reported ELSE ns END AS start_ts, CAST(NOT fits AS INT) AS incomplete
FROM (SELECT *, k * 100000 * (1 + k % 3) * 20 AS reported, k % 5 <> 0 AND k * 100000 * (1 + k % 3) * 20 <= cents * 100000 + 1000000 AS fits FROM ev0)"""
FINAL["fallback_unmatched_tools"] = f"""
SELECT {SES}, 'c' || id AS call_id, CASE WHEN k % 2 = 0 THEN 'Bash' ELSE 'read' END AS name, ns AS start_ts,
       CASE WHEN k % 4 <> 0 THEN ns + cents * 1000 ELSE last_ns END AS end_ts, 1 AS incomplete
FROM ev0 JOIN bounds_u USING (u) WHERE typ = 'click' AND k % 3 = 0"""

# ------------------------------------------------------------------ matching
CTES["streams"] = """
SELECT u, id * 3 AS stream_id, ns - 5000000 AS s0, ns + (k % 9 - 2) * 1000000 AS s1 FROM ev0 WHERE typ = 'view' AND k % 3 <> 0
UNION ALL SELECT u, id * 3 + 1, ns - 7000000, ns + 1000000 FROM ev0 WHERE typ = 'view' AND k % 7 = 0
UNION ALL SELECT u, id * 3 + 2, ns + 2000000, ns + 4000000 FROM ev0 WHERE typ = 'view' AND k % 2 = 0"""
CTES["completions"] = """
SELECT u, id * 3 + j AS id, ns + j * 2000000 AS said, row_number() OVER (PARTITION BY u ORDER BY ns + j * 2000000, id * 3 + j) AS n
FROM ev0, range(3) r(j) WHERE typ = 'view'"""


def _taken(takers: str, near: str, pick: str) -> str:
    """Takers (u, id, n) one after the other with what earlier ones left of the lists in ``near`` (u, n, near)."""
    return f"""WITH RECURSIVE near AS ({near}),
walk AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM {takers}
  UNION ALL
  SELECT u, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick
  FROM (SELECT u, n, used, {pick} AS pick
        FROM (SELECT w.u, w.n + 1 AS n, w.used, list_filter(near, lambda x: NOT list_contains(w.used, x)) AS free FROM walk w JOIN near d ON d.u = w.u AND d.n = w.n + 1)))
"""


FINAL["match_completion_to_stream"] = f"""{_taken(
    "completions",
    "SELECT c.u, c.n, list(stream_id) FILTER (stream_id IS NOT NULL) AS near FROM completions c LEFT JOIN streams s ON s.u = c.u AND s0 <= said + 1000000 AND s1 BETWEEN said - 1000000 AND said + 5000000 GROUP BY ALL",
    "CASE WHEN len(free) = 1 THEN free[1] END",
)}
SELECT c.id, 'session-' || c.u AS session, pick AS stream_id, coalesce(s0, said) AS start_ts, coalesce(s1, said) AS end_ts,
       CAST(pick IS NULL AS INT) AS incomplete, CASE WHEN pick IS NULL THEN 'unmeasured' ELSE 'native-stream' END AS timing
FROM completions c JOIN walk w ON w.u = c.u AND w.n = c.n LEFT JOIN streams s ON s.u = c.u AND s.stream_id = w.pick"""
CTES["log_turns"] = "SELECT u, id, ns AS t0, ns + cents * 40000000000 AS t1, row_number() OVER (PARTITION BY u ORDER BY ns, id) AS n FROM ev0 WHERE typ = 'signup'"
FINAL["match_prompt_log"] = f"""{_taken(
    "log_turns",
    "SELECT t.u, t.n, list(l.id ORDER BY l.ns, l.id) FILTER (l.id IS NOT NULL) AS near FROM log_turns t LEFT JOIN (SELECT * FROM ev0 WHERE typ = 'view') l ON l.u = t.u AND l.ns BETWEEN t0 - 1000000000 AND t1 GROUP BY ALL",
    "free[1]",
)}
SELECT t.id, 'session-' || t.u AS session, pick AS log_id, coalesce(l.ns, t0) AS start_ts, t1 AS end_ts, 0 AS incomplete
FROM log_turns t JOIN walk w ON w.u = t.u AND w.n = t.n LEFT JOIN ev0 l ON l.id = w.pick
UNION ALL
SELECT NULL, 'session-' || u, id, ns, NULL, 1 FROM ev0 WHERE typ = 'view' AND id NOT IN (SELECT pick FROM walk WHERE pick IS NOT NULL)"""
FINAL["match_usage_sample"] = """
SELECT r.id, arg_min(s.id, (s.ns + (s.k % 11 - 3) * 200000000, s.id)) AS sample_id FROM ev0 r JOIN ev0 s ON s.u = r.u
  AND CASE WHEN s.k % 5 = 0 THEN s.k ELSE s.k * 100 END = r.k * 100 AND s.k * 10 = r.k * 10
  AND s.ns + (s.k % 11 - 3) * 200000000 BETWEEN r.ns - 5000000 AND r.ns + 1000000000
WHERE r.typ = 'view' AND s.typ = 'view' AND r.k % 6 <> 0 GROUP BY r.id"""
FINAL["exclude_control_events"] = f"""
WITH c AS (SELECT u, ns + (k % 4) * 900000000 AS at, (k + k % 3) % 10 AS length FROM ev0 WHERE typ = 'signup' AND k % 2 = 0),
p AS (SELECT id, u, ns, k % 10 AS length FROM ev0 WHERE typ = 'signup'),
gone AS (SELECT p.id FROM c ASOF JOIN p ON p.u = c.u AND p.length = c.length AND c.at >= p.ns WHERE c.at - p.ns < 2000000000)
SELECT id, {SES}, ns AS ts, length FROM p WHERE id NOT IN (SELECT id FROM gone)"""
FINAL["asof_configuration"] = f"""
WITH c AS (SELECT u, ns AS cns, 'model-' || (k % 3) AS model, CASE WHEN k % 2 = 0 THEN 'high' END AS effort, 'p' AS provider FROM ev0 WHERE typ = 'signup'),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY u ORDER BY cns) = 1)
SELECT e.id, 'session-' || e.u AS session, e.ns AS ts, CASE WHEN c.cns IS NULL THEN f.model ELSE c.model END AS model,
       CASE WHEN c.cns IS NULL THEN f.effort ELSE c.effort END AS effort, CASE WHEN c.cns IS NULL THEN f.provider ELSE c.provider END AS provider
FROM (SELECT * FROM ev0 WHERE typ = 'click') e ASOF LEFT JOIN c ON c.u = e.u AND e.ns >= c.cns LEFT JOIN f ON f.u = e.u"""
FINAL["asof_last_response"] = """
SELECT r.id AS slice_out, e.id AS slice_in FROM (SELECT * FROM ev0 WHERE typ IN ('click', 'error')) e
ASOF JOIN (SELECT * FROM ev0 WHERE typ = 'view') r ON r.u = e.u AND e.ns >= r.ns"""
FINAL["owner_prompt_containing"] = """
SELECT e.id, arg_min(p.id, (p.ns, p.id)) AS prompt_id FROM ev0 e JOIN ev0 p ON p.u = e.u AND p.typ = 'signup'
  AND e.ns BETWEEN p.ns AND p.ns + p.cents * 20000000000 WHERE e.typ = 'click' GROUP BY e.id"""
FINAL["classify_by_containment"] = f"""
SELECT id, {SES}, ns AS ts, ns + cents * 1000000000 AS end_ts, CAST(EXISTS (SELECT 1 FROM ev0 c WHERE c.u = e.u AND c.typ = 'purchase'
  AND c.ns <= e.ns AND c.ns + c.cents * 30000000000 >= e.ns + e.cents * 1000000000) AS INT) AS in_compaction
FROM ev0 e WHERE typ = 'view'"""

# --------------------------------------------------------------------- trees
CTES["span_tree"] = """
SELECT id, CASE WHEN k % 5 <> 0 THEN prev_id END AS parent_id, u // 2 AS trace, CASE WHEN k % 6 = 0 THEN 'session-' || u END AS session,
       ns AS start_ns, ns + cents * 1000 AS end_ns, k % 3 = 0 AS mapped FROM ev"""
CTES["scope_walk"] = """
SELECT id, parent_id, session FROM span_tree
UNION ALL
SELECT w.id, s.parent_id, s.session FROM scope_walk w JOIN span_tree s ON s.id = w.parent_id WHERE w.session IS NULL"""
CTES["scoped"] = """
SELECT t.id, t.trace, coalesce(w.session, o.session) AS session, start_ns, end_ns FROM span_tree t
LEFT JOIN (SELECT id, max(session) AS session FROM scope_walk GROUP BY id) w USING (id)
LEFT JOIN (SELECT trace, min(session) AS session FROM span_tree GROUP BY trace HAVING count(DISTINCT session) = 1) o ON o.trace = t.trace"""
FINAL["inherit_scope_from_ancestors"] = "SELECT id, 't' || trace AS trace_id, session FROM scoped"
CTES["mapped_walk"] = """
SELECT s.id, s.start_ns AS child_ns, p.id AS found, p.parent_id, p.mapped, p.start_ns FROM span_tree s JOIN span_tree p ON p.id = s.parent_id WHERE s.mapped
UNION ALL
SELECT w.id, w.child_ns, p.id, p.parent_id, p.mapped, p.start_ns FROM mapped_walk w JOIN span_tree p ON p.id = w.parent_id WHERE NOT w.mapped"""
FINAL["nearest_mapped_ancestor_edges"] = "SELECT found AS slice_out, id AS slice_in FROM mapped_walk WHERE mapped AND child_ns >= start_ns"
FINAL["route_telemetry"] = """
SELECT id, session, capture_id, CASE WHEN capture_id IS NOT NULL THEN 'stored' WHEN session IS NULL THEN 'waiting' ELSE 'outside' END AS state
FROM (SELECT s.id, s.session, CASE WHEN s.end_ns >= b.first_ns AND (b.u % 4 = 0 OR s.start_ns <= b.first_ns + (b.last_ns - b.first_ns) // 2) THEN b.u END AS capture_id
      FROM scoped s LEFT JOIN bounds_u b ON s.session = 'session-' || b.u AND b.u % 3 <> 0)"""
CTES["child_links"] = """
SELECT (u - 1) // 2 AS parent, u AS child FROM bounds_u WHERE u > 0 UNION ALL SELECT 5, 0 FROM bounds_u WHERE u = 5"""
CTES["reach"] = """
SELECT u AS seed, u AS node FROM bounds_u
UNION
SELECT r.seed, l.child FROM reach r JOIN child_links l ON l.parent = r.node WHERE r.node % 7 <> 6 AND r.node IN (SELECT u FROM bounds_u)"""
FINAL["reachable_sessions"] = """
SELECT seed, f AS sessions, m AS missing FROM (
  SELECT seed, count(*) FILTER (WHERE node % 7 <> 6 AND node IN (SELECT u FROM bounds_u)) AS f,
         count(*) FILTER (WHERE NOT (node % 7 <> 6 AND node IN (SELECT u FROM bounds_u))) AS m FROM reach GROUP BY seed)"""
FINAL["link_delegations"] = f"""
SELECT id AS launch_id, {SES}, 'kid-' || id AS child_session, CASE WHEN k % 4 <> 0 THEN id * 10 + 1 END AS first_input
FROM ev0 WHERE typ = 'error' AND k % 3 <> 2"""
_FLOW = " || ".join(f"substr(d, {2 * i + 1}, 2)" for i in range(7, -1, -1))
FINAL["delegation_flow_id"] = f"""
SELECT u, uuid AS session, {_FLOW} AS flow_id FROM (SELECT u, uuid, sha256('pi.delegation.first-prompt:' || uuid) AS d FROM uuids)"""
FINAL["extract_child_session"] = """
SELECT id, CASE WHEN k % 3 <> 0 THEN uuid END AS child_session FROM ev0 JOIN uuids USING (u)"""
FINAL["lifecycle_snapshots_to_spans"] = """
SELECT u AS script, id AS call_id, 'models.classify' AS name, ns AS start_ts, CASE WHEN k % 3 <> 0 THEN ns + 100 + cents ELSE last_ns + 1000000 END AS end_ts,
       CASE WHEN k % 3 = 0 THEN 'interrupted' WHEN k % 2 = 0 THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN k % 3 <> 0 THEN CAST(k % 2 AS INT) END AS is_error, CAST(k % 3 = 0 AS INT) AS incomplete
FROM ev0 JOIN bounds_u USING (u) WHERE typ = 'purchase' AND k % 5 <> 0 AND k % 9 <> 0"""

# ---------------------------------------------------------- states and series
FINAL["run_configuration_changes"] = f"""
WITH r AS (SELECT u, id, ns, 'model-' || (k // 40) AS model, CASE WHEN k % 4 <> 0 THEN 'high' END AS effort FROM ev0 WHERE typ = 'view'),
c AS (SELECT *, lag((model, coalesce(effort, '-'))) OVER (PARTITION BY u ORDER BY ns, id) AS was FROM r),
d AS (SELECT * FROM c WHERE was IS NULL OR was <> (model, coalesce(effort, '-')))
SELECT {SES}, ns AS start_ts, lead(ns) OVER (PARTITION BY u ORDER BY ns, id) AS end_ts, model, effort FROM d"""
CTES["usage"] = """
SELECT u, id, ns, CASE WHEN k % 7 <> 0 THEN k * 100 END AS i, CASE WHEN k % 5 <> 0 THEN k * 10 END AS o, CASE WHEN k % 3 <> 0 THEN k END AS cr,
       k * 2 AS cw FROM ev0 WHERE typ = 'view'"""
FINAL["cumulative_counters"] = f"""
WITH r AS (SELECT *, CAST(sum(i) OVER w AS BIGINT) AS ti, CAST(sum(o) OVER w AS BIGINT) AS tt FROM usage WINDOW w AS (PARTITION BY u ORDER BY ns, id))
SELECT {SES}, 'llm.tokens.input' AS name, ns AS ts, ti AS value FROM r WHERE i IS NOT NULL
UNION ALL SELECT {SES}, 'llm.tokens.output', ns, tt FROM r WHERE o IS NOT NULL
UNION ALL SELECT {SES}, n, first_ns, 0 FROM bounds_u, (VALUES ('llm.tokens.input'), ('llm.tokens.output')) t(n)
UNION ALL SELECT {SES}, n, last_ns + 1, 0 FROM bounds_u, (VALUES ('llm.tokens.input'), ('llm.tokens.output')) t(n)"""
FINAL["context_gauge"] = f"""
SELECT {SES}, ns AS ts, i + cr + cw AS value FROM usage WHERE i + cr IS NOT NULL
UNION ALL SELECT {SES}, ns, k * 50 FROM ev0 WHERE typ = 'purchase' AND k % 4 <> 0
UNION ALL SELECT {SES}, ns + cents, CASE WHEN k % 3 <> 0 THEN k * 10 ELSE 0 END FROM ev0 WHERE typ = 'purchase' AND (k % 5 <> 0 OR k % 3 <> 0)"""
FINAL["clip_to_capture"] = f"""
SELECT id, {SES}, greatest(ns, w0) AS start_ts, least(e1, w1) AS end_ts, CAST(k % 10 = 9 OR ns < w0 OR e1 > w1 AS INT) AS incomplete
FROM (SELECT *, ns + cents * 10000000000 AS e1 FROM ev0) JOIN (SELECT u, first_ns + (last_ns - first_ns) // 4 AS w0, last_ns - (last_ns - first_ns) // 4 AS w1 FROM bounds_u) USING (u)
WHERE e1 >= w0 AND ns <= w1"""
FINAL["session_bounds"] = f"""
SELECT u // 10 AS recording, {SES}, min(ns) - CASE WHEN u % 10 = 0 THEN 100 ELSE 0 END AS start_ts,
       CASE WHEN u % 10 = 0 THEN greatest(max(ns + cents), max(ns) + 100) ELSE max(ns + cents) END AS end_ts FROM ev0 GROUP BY u"""
FINAL["segment_revisited_sessions"] = """
WITH f AS (SELECT u // 3 AS s, arg_min(u % 3, (ns, u % 3)) AS first FROM ev0 GROUP BY 1)
SELECT id, 'session-' || s || CASE WHEN u % 3 = first THEN '' ELSE ':' || (u % 3) END AS session, 'session-' || s AS native_session, u % 3 AS segment
FROM ev0 JOIN f ON s = u // 3"""
FINAL["union_recordings"] = """
SELECT u AS recording, id AS local_id, CASE WHEN prev_id IS NOT NULL THEN u END AS parent_recording, prev_id AS parent_local FROM ev"""
CTES["depths"] = """
SELECT u, id, ns, k % 3 <> 0 AS opens, sum(CASE WHEN k % 3 <> 0 THEN 1 ELSE -1 END) OVER (PARTITION BY u ORDER BY ns, id) AS depth FROM ev0 WHERE typ <> 'error'"""
FINAL["close_partial_recording"] = """
WITH cut AS (SELECT max(ns) + 1 AS cutoff FROM ev0)
SELECT u AS track_id, id, 'end' AS type, cutoff AS ts, 1 AS incomplete FROM depths d, cut
WHERE opens AND NOT EXISTS (SELECT 1 FROM depths l WHERE l.u = d.u AND (l.ns, l.id) > (d.ns, d.id) AND l.depth < d.depth)
UNION ALL
SELECT DISTINCT u + 1000000, CAST(NULL AS BIGINT), 'zero', cutoff, 0 FROM ev0, cut WHERE typ = 'error'"""
FINAL["align_clocks"] = """
WITH s AS (SELECT u, k % 3 AS clock, ns - 1000 * k AS src, 1000 * k AS off, id FROM ev0 WHERE typ = 'signup' AND k % 3 <> 2),
f AS (SELECT u, clock, arg_min(off, (src, id)) AS off FROM s GROUP BY ALL)
SELECT e.id, e.u AS recording, e.clock, e.at AS ts, e.at + coalesce(s.off, f.off) AS realtime, CAST(coalesce(s.off, f.off) IS NULL AS INT) AS unresolved
FROM (SELECT id, u, k % 3 AS clock, ns - 12345 AS at FROM ev0 WHERE typ = 'click') e
ASOF LEFT JOIN s ON s.u = e.u AND s.clock = e.clock AND e.at >= s.src LEFT JOIN f ON f.u = e.u AND f.clock = e.clock"""
FINAL["native_usage_totals"] = f"""
SELECT 'session-' || u AS run, {S("coalesce(i, 0)")} AS input_tokens, {S("coalesce(o, 0)")} AS output_tokens,
       {S("coalesce(cr, 0)")} AS cache_read_tokens, {S("cw")} AS cache_write_tokens FROM usage GROUP BY u"""

# ---------------------------------------------------------------------- text
_EMAIL = r"[\w.+%-]+@([\w.-]+\.[a-zA-Z]{2,})"
_HOME = r"(?:/(?:home|Users)/|[A-Z]:\\+Users\\+)([\w.-]+)"
_CRED = r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-(?:ant-)?[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16}|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)"
_ASSIGN = r"""(?i)\b(?:authorization["'']?\s*[:=]\s*["'']?\s*bearer|(?:api[_-]?key|access[_-]?token)["'']?\s*[:=]\s*["''][A-Za-z0-9_/-]{16})"""
FINAL["privacy_findings"] = rf"""
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '{_CRED}') THEN 'credential pattern' END,
  CASE WHEN regexp_matches(text, '{_ASSIGN}') THEN 'credential assignment' END,
  CASE WHEN len(list_filter(regexp_extract_all(text, '{_EMAIL}', 1), lambda d: NOT regexp_matches(d, '^(?:example\.(?:com|org|net)|users\.noreply\.github\.com)$'))) > 0 THEN 'email address' END,
  CASE WHEN len(list_filter(regexp_extract_all(text, '{_HOME}', 1), lambda h: h NOT IN ('example', 'user', 'runner'))) > 0 THEN 'personal home directory' END
], lambda x: x IS NOT NULL), ',') AS findings FROM documents"""
FINAL["bounded_prompt_text"] = """
SELECT doc_id, CAST(length(text) AS INT) AS length, md5(text) AS kept, 0 AS truncated FROM documents"""
FINAL["script_line_count"] = r"""
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS INT) AS lines
FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)"""
FINAL["estimate_tokens"] = """
SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS by_chars, CAST(ceil(strlen(text) / 4) AS BIGINT) AS by_bytes FROM documents"""
FINAL["redact_content"] = """
SELECT id, 'duration_ms,event.name,input_tokens,prompt_length,session.id' AS attributes,
       'duration_ms,event.name,free,input_tokens,prompt_length,session.id' AS fields FROM ev0"""
FINAL["bounded_arguments"] = """
SELECT id, CAST(length(args) AS INT) AS bytes,
       array_to_string(list_transform(range(1, 1 + n), lambda i: 'key' || i), ',') AS keys, 0 AS keys_truncated
FROM (SELECT id, 1 + k % 15 AS n, '{' || array_to_string(list_transform(range(1, 2 + k % 15), lambda i: '"key' || i || '":' || k), ',') || '}' AS args FROM ev0)"""
FINAL["parse_exit_status"] = """
SELECT id, CASE WHEN k % 3 <> 0 AND k % 4 <> 0 THEN k % 5 - 1 END AS exit_code,
       CASE WHEN k % 11 = 0 THEN 1 WHEN k % 3 <> 0 AND k % 4 <> 0 THEN CAST(k % 5 <> 1 AS INT) END AS is_error FROM ev0 WHERE typ IN ('click', 'error')"""

# ----------------------------------------------------------------- item sets
_ROLE = "CASE role WHEN 'system' THEN 'system' WHEN 'assistant' THEN 'assistant' WHEN 'user' THEN 'prompts' ELSE 'unattributed' END"
FINAL["transcript_items"] = f"""
WITH sec AS (
  SELECT conv_id, turn, 0 AS step, 'section:project rules' AS item, 'rules' AS category, CASE WHEN turn % 4 <> 2 THEN text END AS body, turn % 2 = 0 AS used FROM conversations
  UNION ALL SELECT conv_id, turn, 0, 'section:skill ' || (turn % 3), 'skills', text, turn % 2 = 0 FROM conversations
  UNION ALL SELECT conv_id, turn, 0, 'tool:tool' || (turn % 3), 'tools', CAST(to_json({{'name': 'tool' || (turn % 3), 'description': text}}) AS VARCHAR), turn % 3 = 0 FROM conversations
  UNION ALL SELECT conv_id, turn, 1, t, 'tools', NULL, turn % 5 = 4 FROM conversations, (VALUES ('tool:tool0'), ('tool:tool2')) v(t)),
final AS (SELECT * FROM sec WHERE used QUALIFY row_number() OVER (PARTITION BY conv_id, item ORDER BY turn DESC, step DESC) = 1)
SELECT conv_id AS scope, 'message:' || turn AS item_id, {_ROLE} AS category, length(text) AS chars, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens
FROM conversations WHERE length(text) > 0
UNION ALL
SELECT conv_id, item, category, length(body), CAST(ceil(length(body) / 4) AS BIGINT) FROM final WHERE body IS NOT NULL"""
CTES["conv"] = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sample FROM conversations"
CTES["held"] = f"""
SELECT c.conv_id, s.sample, 'm' || c.sample AS item, {_ROLE.replace("role", "c.role")} AS category,
       CAST(ceil(length(c.text) / 4) AS BIGINT) + CASE WHEN s.sample - c.sample = 2 AND c.sample % 2 = 0 THEN 5 ELSE 0 END AS tokens
FROM conv c JOIN conv s ON s.conv_id = c.conv_id AND s.sample BETWEEN c.sample AND c.sample + 2"""


def _diff(baseline: str) -> str:
    return f"""
SELECT n.conv_id AS scope, n.sample, n.item AS item_id, n.category, n.tokens,
       CASE WHEN {baseline.format('n')} THEN 'baseline' WHEN o.item IS NULL THEN 'added' ELSE 'replaced' END AS change,
       n.tokens - CASE WHEN {baseline.format('n')} THEN 0 ELSE coalesce(o.tokens, 0) END AS delta_tokens
FROM held n LEFT JOIN held o ON o.conv_id = n.conv_id AND o.item = n.item AND o.sample = n.sample - 1
WHERE {baseline.format('n')} OR o.item IS NULL OR o.tokens <> n.tokens OR o.category <> n.category
UNION ALL
SELECT o.conv_id, s.sample, o.item, o.category, o.tokens, 'removed', -o.tokens
FROM held o JOIN conv s ON s.conv_id = o.conv_id AND s.sample = o.sample + 1
WHERE NOT ({baseline.format('s')}) AND NOT EXISTS (SELECT 1 FROM held n WHERE n.conv_id = o.conv_id AND n.item = o.item AND n.sample = s.sample)"""


CTES["set_changes"] = _diff("{0}.sample % 4 = 0")
CTES["raw_changes"] = _diff("{0}.sample = 0")
FINAL["context_diff"] = "SELECT * FROM set_changes"
FINAL["retained_changes"] = """
SELECT *, row_number() OVER (PARTITION BY scope, sample ORDER BY abs(delta_tokens) DESC, item_id, change) AS position FROM set_changes"""
FINAL["snapshot_totals"] = f"""
SELECT conv_id AS scope, sample, {S("tokens")} AS estimated_tokens, coalesce(any_value(n), 0) AS changes, CAST(0 AS BIGINT) AS omitted_changes
FROM held LEFT JOIN (SELECT scope AS conv_id, sample, count(*) AS n FROM set_changes GROUP BY ALL) USING (conv_id, sample) GROUP BY conv_id, sample"""
FINAL["encode_sparse_items"] = """
SELECT scope, sample, CASE WHEN change = 'removed' THEN 'remove' ELSE 'set' END AS op, item_id, CASE WHEN change <> 'removed' THEN category END AS category,
       CASE WHEN change <> 'removed' THEN tokens END AS tokens FROM raw_changes
UNION ALL SELECT conv_id, sample, 'reset', NULL, NULL, NULL FROM conv WHERE sample = 0"""
FINAL["fold_sparse_items"] = """
SELECT conv_id AS scope, item AS item_id, category, tokens FROM held JOIN (SELECT conv_id, max(sample) AS sample FROM conv GROUP BY 1) USING (conv_id, sample)"""
FINAL["category_counters"] = f"""
WITH v AS (SELECT conv_id, sample, category, {S("tokens")} AS tokens FROM held GROUP BY ALL),
f AS (SELECT conv_id, category, min(sample) AS first FROM v GROUP BY ALL)
SELECT c.conv_id AS scope, c.sample AS ts, f.category, coalesce(v.tokens, 0) AS tokens FROM conv c JOIN f ON f.conv_id = c.conv_id AND c.sample >= first
LEFT JOIN v ON v.conv_id = c.conv_id AND v.sample = c.sample AND v.category = f.category
UNION ALL SELECT f.conv_id, l.last + 1, f.category, 0 FROM f JOIN (SELECT conv_id, max(sample) AS last FROM conv GROUP BY 1) l ON l.conv_id = f.conv_id"""

# --------------------------------------------------------------- comparisons
FINAL["compare_runs"] = f"""
WITH r AS (SELECT o_orderpriority AS case_name, c_mktsegment AS variant, o_orderstatus, o_orderkey,
             CASE WHEN o_orderkey % 7 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents, o_orderkey % 1000 AS calls
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT case_name, variant, count(*) AS runs, {C("o_orderstatus = 'F'")} AS correct, {C("o_orderkey % 3 <> 0")} AS conformant, {C("o_orderkey % 5 <> 0")} AS valid,
       CAST(quantile_cont(cents, 0.5) AS DOUBLE) AS cents_median, min(cents) AS cents_min, max(cents) AS cents_max,
       CAST(quantile_cont(calls, 0.5) AS DOUBLE) AS calls_median, min(calls) AS calls_min, max(calls) AS calls_max FROM r GROUP BY ALL"""
CTES["spent"] = """
SELECT capture_id, kind, ts, dur FROM slices WHERE NOT incomplete AND (dur > 0 OR (dur >= 0 AND kind <> 'assistant-message'))
  AND kind IN ('assistant-message', 'provider-request', 'tool-execution', 'script', 'model-call')"""
CTES["spent_points"] = """
SELECT capture_id, ts, CASE WHEN kind IN ('assistant-message', 'provider-request') THEN 1 ELSE 0 END AS exchange,
       CASE WHEN kind IN ('tool-execution', 'script', 'model-call') THEN 1 ELSE 0 END AS tools FROM spent WHERE dur > 0
UNION ALL SELECT capture_id, ts + dur, -CASE WHEN kind IN ('assistant-message', 'provider-request') THEN 1 ELSE 0 END,
       -CASE WHEN kind IN ('tool-execution', 'script', 'model-call') THEN 1 ELSE 0 END FROM spent WHERE dur > 0"""
CTES["seg_spent"] = swept("spent_points", "capture_id", ["exchange", "tools"])
FINAL["run_breakdown"] = f"""
WITH w AS (SELECT capture_id, {S("dur", "exchange > 0")} AS ex, {S("dur", "tools > 0")} AS ta, {S("dur", "exchange > 0 OR tools > 0")} AS co FROM seg_spent GROUP BY 1),
s AS (SELECT capture_id, {S("dur", "kind = 'assistant-message'")} AS re, {S("dur", "kind = 'tool-execution'")} AS tw,
        {S("dur", "kind IN ('script', 'model-call')")} AS sc, {S("dur", "kind = 'provider-request'")} AS rq,
        arg_min(dur, ts) FILTER (WHERE kind = 'provider-request') AS fr FROM spent GROUP BY 1)
SELECT capture_id, session, end_ts - start_ts AS wall_ns, coalesce(ex, 0) AS exchange_ns, coalesce(re, 0) AS response_ns, coalesce(tw, 0) AS tool_work_ns,
       coalesce(sc, 0) AS script_ns, coalesce(ta, 0) AS tool_active_ns, rq AS request_ns, fr AS first_request_ns,
       greatest(0, end_ts - start_ts - coalesce(co, 0)) AS uncovered_ns
FROM runs LEFT JOIN w USING (capture_id) LEFT JOIN s USING (capture_id)"""
FINAL["scripted_tool_stats"] = f"""
SELECT capture_id, coalesce(a, 0) AS outer_calls, coalesce(b, 0) AS scripts, coalesce(c, 0) AS executed, coalesce(d, 0) AS nested, total_input, peak_context
FROM runs LEFT JOIN (SELECT capture_id, {C("parent_call_id IS NULL")} AS a, {C("kind = 'script'")} AS b, {C("kind <> 'script'")} AS c, {C("parent_call_id IS NOT NULL")} AS d
  FROM calls GROUP BY 1) USING (capture_id)
LEFT JOIN (SELECT capture_id, {S("coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0)")} AS total_input FROM messages GROUP BY 1) USING (capture_id)"""
FINAL["reconcile_usage"] = """
WITH n AS (SELECT c.capture_id, count(*) AS nested, count(*) FILTER (WHERE s.call_id IS NULL) AS orphans FROM calls c
  LEFT JOIN (SELECT DISTINCT capture_id, call_id FROM calls WHERE kind = 'script') s ON s.capture_id = c.capture_id AND s.call_id = c.parent_call_id
  WHERE c.parent_call_id IS NOT NULL GROUP BY 1)
SELECT u AS capture_id, array_to_string(list_filter([CASE WHEN u % 2 = 1 THEN 'input_tokens' END, CASE WHEN u % 3 = 0 THEN 'tools' END,
  CASE WHEN nested > 0 THEN 'nested' END, CASE WHEN orphans > 0 THEN 'nested call without script' END], lambda x: x IS NOT NULL), ',') AS issues
FROM bounds_u LEFT JOIN n ON capture_id = u"""
FINAL["baseline_delta"] = """
WITH b AS (SELECT input_tokens AS base FROM runs ORDER BY capture_id LIMIT 1)
SELECT capture_id, input_tokens, input_tokens - base AS difference, CASE WHEN base <> 0 THEN (input_tokens - base) * CAST(100 AS DOUBLE) / abs(base) END AS percent FROM runs, b"""
FINAL["context_pressure_delta"] = """
WITH b AS (SELECT context_window_tokens AS w0, context_share AS s0, peak_context AS p0 FROM runs WHERE context_share IS NOT NULL ORDER BY capture_id LIMIT 1)
SELECT capture_id, CASE WHEN coalesce(context_window_tokens = w0, false) AND context_share IS NOT NULL THEN 'share' ELSE 'peak' END AS basis,
       CASE WHEN coalesce(context_window_tokens = w0, false) AND context_share IS NOT NULL THEN context_share - s0 ELSE peak_context - p0 END AS difference FROM runs, b"""
CTES["failed"] = """
SELECT o_orderkey AS id, o_orderpriority AS owner, CAST(round(o_totalprice * 100) AS BIGINT) AS duration_ms, count(f) AS runs, coalesce(sum(f), 0) AS n
FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey
GROUP BY ALL"""
FINAL["failure_history_audit"] = f"""
SELECT owner, {C("n = 0")} AS new, {C("n > 0 AND n = runs")} AS persistent, {C("n > 0 AND n < runs")} AS intermittent, count(*) AS total FROM failed GROUP BY owner"""
FINAL["slowest_new_failures"] = "SELECT id, duration_ms FROM failed WHERE n = 0 ORDER BY duration_ms DESC, id LIMIT 5"
CTES["job_points"] = """
SELECT u, ns AS ts, 1 AS step FROM ev0 WHERE typ = 'click' UNION ALL SELECT u, ns + cents * 10000000000, -1 FROM ev0 WHERE typ = 'click'"""
CTES["seg_job"] = swept("job_points", "u", ["step"])
FINAL["workload_concurrency"] = "SELECT u AS run, max(step) AS peak, max(ts) - min(ts) AS window_ns FROM seg_job GROUP BY u"
FINAL["protocol_checks"] = """
WITH e AS (SELECT DISTINCT u, k % 20 AS j FROM ev0 WHERE typ = 'click'),
o AS (SELECT u, k % 20 AS j, count(*) AS n, min(ns) AS ts FROM ev0 WHERE typ = 'error' GROUP BY ALL),
x AS (SELECT coalesce(e.u, o.u) AS u, coalesce(e.j, o.j) AS j, e.j AS want, n, ts FROM e FULL JOIN o ON o.u = e.u AND o.j = e.j),
p AS (SELECT u, ts, max(ts) OVER (PARTITION BY u ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x WHERE ts IS NOT NULL AND want IS NOT NULL)
SELECT u AS run, count(*) FILTER (WHERE CASE WHEN want IS NULL THEN 0 ELSE 1 END <> coalesce(n, 0)) AS mismatched,
       (SELECT count(*) FROM p WHERE p.u = x.u AND before > ts) AS out_of_order FROM x GROUP BY u"""
FINAL["recording_checks"] = f"""
SELECT 'capture has one session' AS check, count(*) AS violations FROM (SELECT capture_id FROM runs GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'token counters close at zero', {C("v <> 0")} FROM (SELECT track_id, arg_max(value, ts) AS v FROM samples WHERE name LIKE 'llm.tokens.%' GROUP BY 1)
UNION ALL SELECT 'flows start at a slice', count(*) FROM flows WHERE slice_out NOT IN (SELECT id FROM slices)
UNION ALL SELECT 'durations are not negative', {C("dur < -1")} FROM slices
UNION ALL SELECT 'nested calls name a known call', count(*) FROM calls c WHERE parent_call_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.capture_id = c.capture_id AND p.call_id = c.parent_call_id)
UNION ALL SELECT 'clocks are aligned', coalesce({S("event_id % 3")}, 0) FROM events WHERE event_type = 'error' AND event_id % 4 = 0"""
FINAL["worker_overlap_check"] = """
WITH d AS (SELECT p.parent_capture_id AS run, r.capture_id, r.start_ts, r.end_ts FROM parents p JOIN runs r USING (capture_id)),
w AS (SELECT run, max(start_ts) AS ls, min(end_ts) AS fe, max(end_ts) AS le, count(*) AS workers FROM d WHERE capture_id % 5 <> 0 GROUP BY 1),
v AS (SELECT run, min(start_ts) AS rs FROM d WHERE capture_id % 5 = 0 GROUP BY 1)
SELECT run, workers, CAST(workers > 1 AND ls < fe AS INT) AS workers_overlap, CAST(rs >= le AS INT) AS review_after FROM w LEFT JOIN v USING (run)"""
FINAL["interval_union_length"] = f"""
SELECT capture_id, {S("dur", "models + tools + scripts > 0")} AS active_ns, max(models + tools + scripts) FILTER (WHERE dur > 0) AS peak FROM seg_capture GROUP BY 1"""
FINAL["peak_concurrency"] = "SELECT capture_id, max(models + tools + scripts) FILTER (WHERE dur > 0) AS peak FROM seg_capture GROUP BY 1"

# ----------------------------------------------------------------- streaming
FINAL["stream_dedup"] = "SELECT id, u, typ, k FROM ev0"
FINAL["stream_token_totals"] = f"""
SELECT 'session-' || u AS session, {S("i")} AS input_tokens, {S("o")} AS output_tokens, count(i) AS input_samples, count(o) AS output_samples,
       count(*) AS responses FROM usage GROUP BY u"""
FINAL["stream_capture_health"] = f"SELECT u AS recording, {C('k % 4 <> 0')} AS rows, {C('k % 4 = 0')} AS corrupt FROM ev0 GROUP BY u"
# rows leave the state once the watermark (ten minutes, or an hour, behind the newest event) has passed them
CTES["newest"] = "SELECT max(ns) // 1000 AS us FROM ev0"
FINAL["stream_pair_begin_end"] = """
SELECT 's' || u AS scope, typ AS event, id, ns // 1000 AS start_us,
       ns // 1000 + CASE WHEN ended THEN cents ELSE 3600000000 END AS end_us, CAST(NOT ended AS INT) AS incomplete
FROM (SELECT *, coalesce(k % 4 <> 0 AND cents BETWEEN 0 AND 3600000000, false) AS ended FROM ev0)"""
FINAL["stream_activity_bins"] = """
SELECT ns // 1000 // 3600000000 * 3600000000 AS start_us, typ AS kind, count(*) AS events FROM ev0 GROUP BY 1, 2"""
FINAL["stream_prompt_clusters"] = """
WITH p AS (SELECT u, ns // 1000 AS us FROM ev0 WHERE typ = 'signup'),
g AS (SELECT u, us, sum(fresh) OVER (PARTITION BY u ORDER BY us) AS grp FROM
  (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY u ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM p))
SELECT u AS capture_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS prompts FROM g GROUP BY u, grp"""
FINAL["stream_route_telemetry"] = """
SELECT 't' || u AS trace_id, CAST(id AS VARCHAR) AS id, 'session-' || u AS session, 'routed' AS state FROM ev0
WHERE u IN (SELECT u FROM ev0 WHERE k % 6 = 0)"""
CTES["two_items"] = """
SELECT u, id, 'm' || (k // 50) AS model, 'a' AS item, 'prompts' AS category, k AS tokens, k % 17 = 0 AS fresh FROM ev0 WHERE typ = 'view'
UNION ALL SELECT u, id, 'm' || (k // 50), 'b' || (k % 3), 'results', 5, k % 17 = 0 FROM ev0 WHERE typ = 'view'"""
CTES["sample_steps"] = """
SELECT u, id, fresh OR lag(model) OVER w IS DISTINCT FROM model AS base, lag(id) OVER w AS before
FROM (SELECT DISTINCT u, id, model, fresh FROM two_items) WINDOW w AS (PARTITION BY u ORDER BY id)"""
FINAL["stream_context_diff"] = """
SELECT 's' || n.u AS scope, n.id AS sample, n.item AS item_id, n.category, n.tokens,
       CASE WHEN base THEN 'baseline' WHEN o.item IS NULL THEN 'added' ELSE 'replaced' END AS change, n.tokens - coalesce(o.tokens, 0) AS delta_tokens
FROM two_items n JOIN sample_steps s ON s.u = n.u AND s.id = n.id LEFT JOIN two_items o ON NOT base AND o.u = n.u AND o.id = before AND o.item = n.item
WHERE o.item IS NULL OR o.tokens <> n.tokens
UNION ALL
SELECT 's' || s.u, s.id, o.item, o.category, o.tokens, 'removed', -o.tokens
FROM sample_steps s JOIN two_items o ON o.u = s.u AND o.id = before LEFT JOIN two_items n ON n.u = s.u AND n.id = s.id AND n.item = o.item
WHERE NOT base AND n.item IS NULL"""

FINAL["interval_sweep"] = "SELECT * FROM seg_capture"
FINAL["read_trace_tables"] = """
SELECT 'slice' AS name, count(*) AS rows FROM slices UNION ALL SELECT 'track', 12 * count(*) FROM sess
UNION ALL SELECT n, count(*) FROM sess, (VALUES ('process_track'), ('thread_track'), ('thread')) t(n) GROUP BY n
UNION ALL SELECT 'process_counter_track', 0 UNION ALL SELECT 'process', count(DISTINCT u // 2) FROM sess
UNION ALL SELECT 'counter_track', 7 * count(*) FROM sess UNION ALL SELECT 'counter', count(*) FROM samples
UNION ALL SELECT 'flow', count(*) FROM flows UNION ALL SELECT 'stats', count(*) FROM events WHERE event_type = 'error'"""
