"""Every query of the engine itself against its SQL."""

import pytest

from tessella.plans import catalogue
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name]) > 0
