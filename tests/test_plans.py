"""Every query of the engine's own operators against DuckDB, on the smallest tables."""

import pytest

from graniteql.plans import registry

from .compare import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    same(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name])
