"""Every named query against its SQL on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    apart = {name for name in QUERIES if name == "pipeline" or name.startswith("op")}  # held against brute force in tests/llm
    assert set(QUERIES) - apart == set(SQL) - apart


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    verdict = compare(spark, SF, name, QUERIES[name], SQL[name], con)
    assert verdict.startswith("ok"), verdict


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
