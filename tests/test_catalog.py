import pytest
from oracle import same

from wayloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], SF)
