import pytest
from twins import check

from lodeframe.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query_and_twin(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE[name])
