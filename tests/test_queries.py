import pytest

import catalog_queries
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalog_queries.QUERIES[name](spark, SF)
    assert oracle.difference(df, con, catalog_queries.SQL[name]) is None


def test_every_query_has_sql():
    assert set(catalog_queries.QUERIES) == set(catalog_queries.SQL)
