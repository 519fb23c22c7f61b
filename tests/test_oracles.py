"""Every registered query of the core against its oracle on the smallest tables."""

import oracle
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert oracle.differences(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) == ""
