"""Every query against its SQL twin on the shared tables."""

import pytest
from compare import connect, differences

from workload import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert not differences(QUERIES[name](spark, SF), con, ORACLE[name])


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)
