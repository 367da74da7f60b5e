import pytest

from strataloom.plans import catalogue, core_problems
from tests.conftest import same

ALL_SQL = [(m, n) for m in (catalogue, core_problems) for n in m.SQL]
NO_SQL = [(m, n) for m in (catalogue, core_problems) for n in m.QUERIES if n not in m.SQL]


@pytest.mark.parametrize(("module", "name"), ALL_SQL, ids=[n for _, n in ALL_SQL])
def test_equals_sql(spark, data, module, name):
    same(module.QUERIES[name](spark, data), module.SQL[name], data)


@pytest.mark.parametrize(("module", "name"), NO_SQL, ids=[n for _, n in NO_SQL])
def test_runs(spark, data, module, name):
    df = module.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry_module(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
