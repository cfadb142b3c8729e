import pytest

from meshgrain.plans.oracles import ORACLES
from meshgrain.plans.queries import QUERIES
from tests.compare import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, QUERIES[name], ORACLES[name]) == []


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)
