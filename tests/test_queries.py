"""Every registered query against its SQL; those without SQL return rows."""

import pytest
from compare import same
from conftest import SF

from corpusmith import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql:
        same(df, sql, SF)
    else:
        assert df.count() > 0
