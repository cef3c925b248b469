import pytest
from corvane.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(same_as_sql, name):
    same_as_sql(queries, name)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
