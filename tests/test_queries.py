"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import pytest

from acervo.plans import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name], SF) > 0
