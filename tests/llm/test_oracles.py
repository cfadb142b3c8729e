import pytest

from meshgrain.llm.queries import ORACLES, QUERIES
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
