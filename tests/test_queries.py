import pytest

from apexframe.plans.registry import ORACLES, QUERIES
from twins import DATA, rows, twin


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(twin(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
