import pytest
from oracle import compare

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_the_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.SQL[name])
