import pytest

from callgauge.plans import catalogue
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_filters_reach_the_scan(spark, tmp_path):
    from callgauge.operators import reads
    from callgauge.sources.store import CallStore

    plan = reads.logs_for_run(CallStore(spark, str(tmp_path)).calls(), "r")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(eval_run_id,r)" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_plans(spark):
    from tests.oracle import SF

    plan = lambda n: catalogue.queries()[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("inspect_recent")
    assert "BroadcastHashJoin" in plan("metric_points")
    assert "WindowGroupLimit" in plan("stratified_sample")
    assert plan("metric_points").count("FileScan") == 1
    assert "Python" not in plan("metric_points") and "Arrow" not in plan("metric_points")
