"""DuckDB SQL for the queries that SQL can express, written apart from the operators.

Without SQL, and so tested against brute force or the library: the approximate
search (2), tokenizers (4, 7), the trained models (5, 9, 10), eigenvectors (12)
and the choice of a knapsack (13).
"""

from __future__ import annotations

_REACH = """
reach(node, component) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT l.b, r.component FROM reach r JOIN links l ON l.a = r.node WHERE l.b > r.component
),
smallest AS (SELECT node, min(component) AS component_id FROM reach GROUP BY node)
"""

OP1 = """
WITH raw AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), hashed AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM raw
), coded AS (
  SELECT page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::BIGINT) >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last_id
  FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM coded
"""

OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.95
), nodes AS (SELECT vec_id AS node FROM v),
{_REACH}
SELECT node AS vec_id, (SELECT count(*) FROM links l WHERE l.a = s.node) AS n_links, component_id, node = component_id AS kept
FROM smallest s
"""

OP6 = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM worded
), grams AS (SELECT DISTINCT doc_id, s FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM grams x JOIN grams y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)),
nodes AS (SELECT doc_id AS node FROM documents),
{_REACH}
SELECT node AS doc_id, coalesce((SELECT n FROM sizes z WHERE z.doc_id = node), 0)::BIGINT AS n_shingles, component_id FROM smallest
"""


def _found(name: str, pattern: str, options: str = "") -> str:
    """Rows (doc_id, start, stop, s) of all leftmost matches: lengths of the pieces between them add up to the places."""
    quoted = pattern.replace("'", "''")
    return f"""
{name}_all AS (
  SELECT doc_id, regexp_extract_all(t, '{quoted}', 0{options}) AS m, list_transform(string_split_regex(t, '{quoted}'{options}), lambda p: len(p)) AS gap FROM src
), {name} AS (
  SELECT doc_id, m[i] AS s, list_sum(gap[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS start
  FROM (SELECT doc_id, m, gap, unnest(range(1, len(m) + 1)) AS i FROM {name}_all)
)"""


def _entropy(name: str, window: int) -> str:
    """The same strings with the largest entropy of the windows of what stands between their words, each window counted on its own."""
    return f"""
{name}_pieces AS (
  SELECT doc_id, s, start, unnest(string_split(regexp_replace(array_to_string(list_transform(string_split(s, '/'), lambda g:
    CASE WHEN regexp_matches(g, '^([A-Za-z]{{2,}}[-_])+[A-Za-z]{{2,}}[0-9]{{0,4}}$') OR (contains(s, '/') AND regexp_matches(g, '^[A-Za-z]{{2,}}[-_]?[0-9]{{0,4}}$'))
      THEN ' ' ELSE g END), '/'), '/? /?', ' ', 'g'), ' ')) AS p
  FROM {name}
), {name}_best AS (
  SELECT doc_id, s, start, max(list_max(list_transform(range(1, len(p) - {window} + 2), lambda i:
    -list_sum(list_transform(list_distinct(string_split(substr(p, i, {window}), '')), lambda c:
      (len(substr(p, i, {window})) - len(replace(substr(p, i, {window}), c, ''))) / {window}.0
      * log2((len(substr(p, i, {window})) - len(replace(substr(p, i, {window}), c, ''))) / {window}.0)))))) AS bits
  FROM {name}_pieces WHERE len(p) >= {window} GROUP BY doc_id, s, start
)"""


_ALLOWED = " OR ".join(
    f"regexp_matches(s, '{p}')"
    for p in ("(?i)example|placeholder|changeme|dummy|xxxx|redacted|your[-_]", "^/[a-z]+/(.*/)?[a-z]+$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "^sha(1|256|384|512)[-_]")
) + " OR len(list_filter(range(1, len(s) - 4), lambda i: len(replace(substr(s, i, 6), s[i], '')) = 0)) > 0"
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind of added spans, runs they come from, what the whole run must be, what it must hold, window, bits.
_KINDS = (
    ("entropy_hex", "alnum", "[0-9A-F]{32,}", ("[0-9]", "[A-F]"), 32, 3.0),
    ("entropy_token", "longer", ".{24,}", ("[0-9]", "[a-z]", "[A-Z]"), 24, 3.8),
    ("entropy_lower", "alnum", "[a-z0-9]{25,}", ("[0-9]", "[g-z]"), 25, 3.6),
    ("entropy_upper", "alnum", "[A-Z0-9]{25,}", ("[0-9]", "[G-Z]"), 25, 3.6),
)

OP8 = f"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("assign", _ASSIGN)}, {_found("access", "AKIA[A-Z0-9]+")}, {_found("hexes", "[0-9a-f]+")},
{_found("alnum", "[A-Za-z0-9]+")}, {_found("longer", "[A-Za-z0-9+/_=-]+")},
{", ".join(f"{kind} AS (SELECT * FROM {runs} WHERE regexp_full_match(s, '{whole}') AND {' AND '.join(f"regexp_matches(s, '{part}')" for part in parts)})" for kind, runs, whole, parts, _, _ in _KINDS)},
{", ".join(_entropy(kind, window) for kind, _, _, _, window, _ in _KINDS)},
spans AS (
  SELECT doc_id, start, 0 AS rank, 'assign' AS kind, start + len(s) AS stop FROM assign WHERE len(regexp_extract(s, '{_ASSIGN.replace("'", "''")}', 2)) >= 12
  UNION ALL SELECT doc_id, start, 1, 'access', start + len(s) FROM access WHERE len(s) >= 18
  UNION ALL SELECT doc_id, start, 2, 'hex', start + len(s) FROM hexes WHERE len(s) >= 16
  {" ".join(f"UNION ALL SELECT doc_id, start, {3 + k}, '{kind}', start + len(s) FROM {kind}_best WHERE round(bits, 6) >= {bits} AND NOT ({_ALLOWED})" for k, (kind, *_, bits) in enumerate(_KINDS))}
), joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""

OP11 = """
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), counted AS (
  SELECT k, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT k, sum(tf)::BIGINT AS n FROM counted GROUP BY k
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM lengths
), wanted AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  WHERE item_id IS NOT NULL GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, whole GROUP BY term, docs
), impacts AS (
  SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS impact
  FROM counted JOIN lengths USING (k) JOIN weighed USING (term), whole WHERE term IN (SELECT term FROM wanted)
), scored AS (
  SELECT item_id, k, doc_id, sum(repeats * impact)::BIGINT AS score FROM impacts JOIN wanted USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

SQL: dict[str, str] = {
    "op1_warc_packages": OP1,
    "op3_multi_index_duplicates": OP3,
    "op6_ngram_jaccard_join": OP6,
    "op8_secret_scan": OP8,
    "op11_pair_bound_search": OP11,
}
