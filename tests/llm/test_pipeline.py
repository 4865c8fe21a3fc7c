"""The pipeline stage by stage against plain Python, and the registered queries."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from spanloom.llm import oracle, queries
from tests.llm.cases import documents, words
from tests.llm.test_texts import base_spans, plain_join

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, " ".join(words(i, 60)) if i % 3 else " ".join(x.upper() + "%%%" for x in words(i, 60))) for i in range(400)]
    rows += [(500 + i, rows[1][1]) for i in range(20)] + [(600, rows[2][1] + " tail")]
    rows += [(700, " ".join(words(700, 40)) + " token = abcdefghij0123456789 rest"), (701, None), (702, ""), (703, "9 9 9"), (None, " ".join(words(703, 30)))]
    documents(spark, rows, more=False).withColumn("lang", F.col("source")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {"start": docs.count()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        seen[name] = len(after)
        if name == "good_quality":
            assert not any(i is not None and i < 400 and i % 3 == 0 for i in after)
            assert all(i in after for i in before if i is not None and i < 400 and i % 3)
        if name == "known_language":
            assert 703 not in after and 702 not in after and 701 not in after
        if name == "one_of_each_group":
            want = plain_join([(i, t) for i, t in before.items()])
            assert {i for i in after if i is not None} == {i for i, (_, c) in want.items() if c == i} and None in after
        if name == "without_secrets":
            assert "abcdefghij0123456789" not in after[700] and "[REDACTED]" in after[700]
            assert all(base_spans(t or "") == "" for t in after.values())
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    rows = corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert {r.doc_id for r in rows} == set(after) and all(r.offset + r.length <= 4096 for r in rows)
    run = corpus_pipeline.run(spark, folder)
    assert sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in run.collect()) == sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in rows)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registration():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in queries.QUERIES} and set(queries.QUERIES) <= set(names)
    assert names["pipeline"] is corpus_pipeline.run and set(oracle.SQL) <= set(queries.QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)) + ["pipeline"])
def test_queries_run_on_the_given_tables(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
