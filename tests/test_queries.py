"""Every registered core query: equal to its SQL in DuckDB, or at least running with a stable schema."""

import pytest

from compare import connection, of_df, of_sql
from quillgraph.operators import value_queries
from quillgraph.plans import acceptance_queries, acquisition_queries, document_queries, fact_queries, graph_queries

PLANS = (fact_queries, graph_queries, document_queries, acceptance_queries, acquisition_queries)
QUERIES = {n: f for m in PLANS for n, f in m.Q.items()}
SQL = {n: t for m in PLANS for n, t in m.SQL.items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, con, name):
    assert of_df(QUERIES[name](spark, sf_dir)) == of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_values_run(spark, sf_dir, con):
    for name, f in value_queries.QUERIES.items():
        assert f(spark, sf_dir).count() > 0
        assert name not in value_queries.SQL or of_df(f(spark, sf_dir)) == of_sql(con, value_queries.SQL[name])


def test_names_are_unique():
    assert len(QUERIES) == sum(len(m.Q) for m in PLANS)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()
    assert e.entry(spark).count() > 0
