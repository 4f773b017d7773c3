import pytest

import __spark_entry__ as entry
from twins import check

OWN = {name: sql for catalog in entry.CATALOGS for name, sql in catalog.ORACLE.items()}


@pytest.mark.parametrize("name", OWN)
def test_query_and_twin(spark, name):
    check(spark, entry.queries()[name], OWN[name])
