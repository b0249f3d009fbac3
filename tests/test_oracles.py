"""Every core query against its SQL twin."""

import pytest
from compare import rows

from reviewloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in registry.SQL:
        assert rows(got) == rows(duck.sql(registry.SQL[name]).df())
