"""What the plans must not contain, whatever the data size."""

import os

import pytest

import __spark_entry__ as entry
from chatterlens.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
BATCH = [name for name in registry.QUERIES if not name.startswith(("stream_", "store_"))]


def plan_of(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pair_joins_and_no_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "ArrowEval" in plan) == (name == "scorer_quads")


@pytest.mark.parametrize("name", BATCH)
def test_global_windows_only_over_limited_rows(spark, name):
    lines = plan_of(spark, name).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "\n".join(lines[i + 1:i + 3])
            assert "partial_" in below or "Limit" in below, line


def test_scan_reads_only_needed_columns(spark):
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan_of(
        spark, "program_score_now")
    assert "ReadSchema: struct<source:string>" in plan_of(spark, "video_counts")


def test_range_bound_reaches_the_scan(spark):
    plan = plan_of(spark, "range_label_filter")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "user_id" in line)
    assert "(ts" in scan and "Subquery" in scan


def test_one_rollup_feeds_points_and_baseline(spark):
    frame = entry.queries()["anomalies_volume"](spark, FOLDER)
    frame.collect()
    assert "ReusedExchange" in frame._jdf.queryExecution().executedPlan().toString()
