"""Every query against its SQL on the smallest tables."""

import pytest

from evidra import registry
from tests.conftest import DATA
from tests.oracle import common, connection

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert common(got) == common(want)


def test_all_have_oracles():
    assert set(registry.queries()) == set(ORACLES)
