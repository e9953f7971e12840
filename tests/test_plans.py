"""Plans must not contain what does not scale."""

import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF

#: Queries that run while they are built, and those of the corpus operators, which have tests of their own.
OTHERS = ("stream_", "op", "pipeline", "train_severity_model", "score_with_model", "anomaly_model", "benchmark_load")
NAMES = [n for n in entry_points.queries() if not n.startswith(OTHERS)]
#: Joins with one row of totals.
ONE_ROW = {"soc_kpis", "system_load", "alert_pipeline_delay", "alert_incident_delay", "live_activity", "event_log_page", "flagged_events",
           "review_queue"}


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    plan = entry_points.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in plan or (word == "BroadcastNestedLoopJoin" and name in ONE_ROW)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "+- Window [" in line or "Window [" in line.split("(")[0]:
            below = next((x for x in lines[i + 1:] if "Exchange" in x), "")
            assert "SinglePartition" not in below


def test_time_filter_reaches_the_scan(spark):
    plan = entry_points.queries()["time_window_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert "value" not in plan.split("ReadSchema")[1]
