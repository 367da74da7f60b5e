import pytest

from strataloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_products(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
