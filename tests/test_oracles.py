"""Every query that has SQL gives the rows of its SQL on the smallest tables."""

import pytest

from oracle import compare
from quern.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, name):
    assert compare(spark, data, name, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
