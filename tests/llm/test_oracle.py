import pytest
from oracle import compare

from cubeloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], small)
