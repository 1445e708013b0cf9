"""Every registered query against its DuckDB equivalent, over the smallest tables."""

import pytest

from seqloom.plans import catalog
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, name):
    assert compare.differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
