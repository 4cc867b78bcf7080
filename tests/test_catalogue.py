"""Every registered query of the engine gives what DuckDB gives."""

import pytest

from larder.plans import catalogue
from tests.helpers import assert_same


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tiny, name):
    assert_same(catalogue.QUERIES[name](spark, tiny), catalogue.ORACLES[name], tiny)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, tiny):
    plan = catalogue.QUERIES["dq_range"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<s_suppkey:bigint,s_acctbal:double>" in plan and "PushedFilters: [Or(" in plan
