"""Every query of the reference's operators against its SQL."""

import pytest
from compare import connect, same

from sedimenta.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, duck):
    same(registry.QUERIES[name](spark, sf), duck, registry.ORACLES[name])
