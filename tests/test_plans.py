"""What the plans must and must not hold."""

import re

import pytest

from strataloom.plans import catalogue, core_problems

ALL = [(m, n) for m in (catalogue, core_problems) for n in m.QUERIES]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("module", "name"), ALL, ids=[n for _, n in ALL])
def test_no_products(spark, data, module, name):
    plan = plan_of(module.QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("pattern_distribution", {"pattern_id", "log_source_id", "id", "file_path"}),
        ("time_series_hour", {"pattern_id", "entry_timestamp"}),
        ("stats_by_group", {"id", "name", "file_group_id", "occurrence_count"}),
        ("anomalies", {"id", "name", "file_group_id", "occurrence_count", "pattern_id", "log_source_id"}),
    ],
)
def test_columns_read(spark, data, name, columns):
    plan = plan_of(catalogue.QUERIES[name](spark, data))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in s.split(",")}
    assert read == columns


def test_filters_reach_the_scan(spark, data):
    plan = plan_of(catalogue.QUERIES["ranked_patterns"](spark, data))
    assert "GreaterThan(occurrence_count,0)" in plan
    assert "TakeOrderedAndProject" in plan


def test_samples_are_limited_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan_of(catalogue.QUERIES["pattern_samples"](spark, data))


def test_range_join_is_an_equi_join(spark, data):
    plan = plan_of(catalogue.QUERIES["correlations"](spark, data))
    assert re.search(r"(SortMergeJoin|HashJoin)[^\n]*\[bin", plan)
