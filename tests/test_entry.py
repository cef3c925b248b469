import __spark_entry__ as entry
import pytest
from corvane import queries_data, queries_engine


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns == ["c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries_engine.SQL))
def test_engine_query_equals_sql(same_as_sql, name):
    same_as_sql(queries_engine, name)


@pytest.mark.parametrize("name", sorted(queries_data.SQL))
def test_data_query_equals_sql(same_as_sql, name):
    same_as_sql(queries_data, name)
