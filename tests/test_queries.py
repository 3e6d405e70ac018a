"""Every query of the engine's own operators against its SQL."""

import pytest

from lamina import plans
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", plans.ORACLE_SQL)
def test_query_equals_sql(spark, con, name):
    oracle.compare(spark, con, plans.QUERIES[name], plans.ORACLE_SQL[name])


def test_all_have_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)
