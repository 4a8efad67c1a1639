"""Plan properties of every registered query (no job needed beyond any bounded
pre-pass a plan runs while it is built): no Cartesian product, no nested-loop join,
and the parquet scans read only the columns they need."""

import os

import pytest

import __spark_entry__ as E
from caliper.plans.registry import load_all

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


#: Windows over a table of one row per partition or per metrics row, not over row data.
SMALL_WINDOWS = {"order_row_ids", "first_customer_orders", "read_ids_orders"}


@pytest.mark.parametrize("name", sorted(load_all()[0]))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in SMALL_WINDOWS and "Window" in plan:      # no window gathers a table in one partition
        assert "SinglePartition, ENSURE_REQUIREMENTS" not in plan.split("Window", 1)[1].split("\n+-")[0]


def test_parse_plan_runs_no_job(spark):
    """Building a parse plan over a joined input starts no job."""
    from caliper.operators import replies as R
    a = spark.range(100).selectExpr("id", "'{}' AS text")
    joined = a.join(spark.range(50), "id").groupBy("id").agg({"text": "max"}).withColumnRenamed("max(text)", "text")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    R.family_top3(R.parse_replies(joined, "text"))
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scan_prunes_columns(spark):
    df = E.queries()["binary_metrics_lineitem"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln or "Scan parquet" in ln]
    assert scan and all("l_comment" not in ln and "l_orderkey" not in ln for ln in scan)
