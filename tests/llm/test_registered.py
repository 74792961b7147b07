"""Registered queries against their SQL, and the pipeline's stages on the smallest data."""

import pytest

import corpus_pipeline
from loomgraph.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES[name], SQL[name]) is None


def test_each_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
    assert 0 < docs.select("doc_id").distinct().count() < rows
