"""What the physical plans look like, without running them."""

from __future__ import annotations

import pytest
from conftest import TESTDATA

from tillsight.operators import root_cause, segmentation
from tillsight.plans.catalog import QUERIES, REF_YEAR
from tillsight.sources import tpch_star

SMALL = f"{TESTDATA}/sf0.001"
RUNS_ON_CALL = {"stream_daily_revenue", "stream_first_reached", "stream_counted_revenue"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_ON_CALL))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not any(node in plan for node in ("EvalPython", "InPandas", "InArrow"))


def test_scan_reads_only_the_needed_columns(spark):
    plan = plan_of(QUERIES["price_tier_revenue"](spark, SMALL))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan


def test_recent_window_reaches_the_scan(spark):
    plan = plan_of(QUERIES["baseline_metrics"](spark, SMALL))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "o_custkey" in line][0]
    assert "o_orderdate#" in scan and ">= Subquery" in scan


def test_event_filter_is_pushed_down(spark):
    plan = plan_of(QUERIES["trading_band_sales"](spark, SMALL))
    assert "EqualTo(event_type,purchase)" in plan


def test_dimension_joins_follow_the_measured_size(spark):
    """Small sides are broadcast; past the threshold the same query shuffles."""
    star = tpch_star.tpch_star(spark, SMALL)
    lines = star.sales("customer_id", "quantity")

    def query():
        return segmentation.age_segment_quantity(lines, star.customers, REF_YEAR)

    rows = query().collect()
    assert "BroadcastHashJoin" in plan_of(query())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = query()
        assert "SortMergeJoin" in plan_of(shuffled) and "BroadcastHashJoin" not in plan_of(shuffled)
        assert shuffled.collect() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_sales_are_folded_before_the_customer_join(spark):
    star = tpch_star.tpch_star(spark, SMALL)
    plan = plan_of(segmentation.age_segment_quantity(star.sales("customer_id", "quantity"), star.customers, REF_YEAR))
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join [customer_id" in line)
    below = "\n".join(plan.splitlines()[join:])
    assert "partial_sum(quantity" in below


def test_inventory_is_not_broadcast_by_an_estimate_of_one_row_per_part(spark):
    star = tpch_star.tpch_star(spark, SMALL)
    plan = plan_of(root_cause.section_floor(star.inventory, star.products, star.sections))
    join = next(line for line in plan.splitlines() if "Join [product_id" in line)
    assert "SortMergeJoin" in join
