"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry_points
from loomgraph.catalog import REGISTERED
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_matches_sql(spark, db, name):
    registered = REGISTERED[name]
    assert compare(spark, db, FOLDER, registered.run, registered.sql) is None


def test_entry_points_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(REGISTERED) <= set(entry_points.queries())


@pytest.mark.parametrize("name", ["search_code_text", "node_upsert", "debounce_sessions", "enclosing_smallest"])
def test_result_does_not_depend_on_partitioning(spark, name, monkeypatch):
    from loomgraph.catalog import graphs, sources, usage
    from loomgraph.sources import tables

    run = REGISTERED[name].run
    before = sorted(map(repr, run(spark, FOLDER).collect()))

    def shuffled(session, folder, table):
        return session.read.parquet(f"{folder}/{table}.parquet").repartition(7)

    for module in (graphs, sources, usage, tables):
        monkeypatch.setattr(module, "table", shuffled)
    assert sorted(map(repr, run(spark, FOLDER).collect())) == before
