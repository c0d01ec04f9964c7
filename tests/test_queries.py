"""Every registered query against its check SQL on the smallest tables."""

import os

import pytest
from check_queries import compare, connect

from boxtally.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
