"""Queries over all rows of their tables, against SQL without limits or filters."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, compare

SF = os.environ.get("WHOLE_TABLES_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
QUERIES = entry.queries()

_HISTORY = """
WITH runs AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY ALL),
failed AS (SELECT o_orderkey AS id, o_orderpriority AS owner, CAST(round(o_totalprice * 100) AS BIGINT) AS duration_ms,
  count(f) AS runs, coalesce(sum(f), 0) AS n FROM orders LEFT JOIN runs ON l_orderkey = o_orderkey GROUP BY ALL)"""
WHOLE = {
    "failure_history_audit": f"""{_HISTORY}
SELECT owner, count(*) FILTER (WHERE n = 0) AS new, count(*) FILTER (WHERE n > 0 AND n = runs) AS persistent,
       count(*) FILTER (WHERE n > 0 AND n < runs) AS intermittent, count(*) AS total FROM failed GROUP BY owner""",
    "slowest_new_failures": f"{_HISTORY} SELECT id, duration_ms FROM failed WHERE n = 0 ORDER BY duration_ms DESC, id LIMIT 5",
    "stream_activity_bins": """
SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type AS kind, count(*) AS events FROM events GROUP BY ALL""",
    "stream_prompt_clusters": """
WITH p AS (SELECT user_id AS u, epoch_us(ts) AS us FROM events WHERE event_type = 'signup'),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY u ORDER BY us) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM p),
g AS (SELECT u, us, sum(fresh) OVER (PARTITION BY u ORDER BY us) AS grp FROM f)
SELECT u AS capture_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS prompts FROM g GROUP BY u, grp""",
}
#: Parts of the registered SQL that would cut a table or a text.
CUTS = ("typ IN ('view', 'click')", "typ IN ('error', 'purchase') GROUP", "substr(text", "l_linenumber <=", "(SELECT us FROM newest)")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole(spark, con, name):
    verdict = compare(spark, SF, name, QUERIES[name], WHOLE[name], con)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("name", ["flatten_otlp_spans", "otel_attributes", "flatten_otlp_logs", "flatten_session_export", "export_diagnostics", "transcript_items", *WHOLE])
def test_registered_sql_has_no_cut(name):
    assert not [cut for cut in CUTS if cut in entry.oracle_sql()[name]]


def test_every_order_counts(spark, con):
    got = sum(r["total"] for r in QUERIES["failure_history_audit"](spark, SF).collect())
    assert got == con.execute("SELECT count(*) FROM orders").fetchone()[0]
