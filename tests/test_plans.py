"""Plan properties the scale design relies on, checked on the executed (adaptive) plans."""

import re

import pytest

from bazaar.operators import reports
from bazaar.plans import catalog
from bazaar.sources.tables import sales_table

SF = "/root/testdata/sf0.001"
# These read the fact only in the job, run while the plan is built, that writes their table of values.
# The moments before the cells; the same scan for moments of its points is one more that runs no second time.
TWICE = {"sales_density"}
CHECKPOINTED = {"describe_numeric", "dimension_values", "age_density", "age_histogram"}


def final_plan(df) -> str:
    """The plan as it ran, without the initial plans that it and its subqueries started from."""
    df.collect()
    kept, skip = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :"))
        if skip is not None and depth > skip:
            continue
        skip = depth if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


def fact_scans(plan: str, location: str) -> int:
    return sum(1 for line in plan.splitlines() if "FileScan parquet" in line and location in line)


@pytest.mark.parametrize("name", sorted(catalog.REPORTS))
def test_no_cartesian_and_single_scan(spark, name):
    fact = sales_table(spark, SF)
    location = fact.inputFiles()[0].rsplit("/", 4)[1]  # the folder of the table and its versions
    plan = final_plan(catalog.REPORTS[name](fact))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in TWICE:
        assert fact_scans(plan, location) == 2, plan
    elif name in CHECKPOINTED:
        assert fact_scans(plan, location) == 0, plan
    else:
        assert fact_scans(plan, location) == 1, plan


def test_reports_read_only_their_columns(spark):
    fact = sales_table(spark, SF)
    plan = final_plan(reports.total_revenue(fact))
    assert re.findall(r"ReadSchema: (struct<[^\n]*>)", plan) == ["struct<Total_Sales:decimal(14,2)>"]
    plan = final_plan(reports.revenue_by_city(fact))
    assert re.findall(r"ReadSchema: (struct<[^\n]*>)", plan) == [
        "struct<Customer_ID:string,City:string,Total_Sales:decimal(14,2)>"]


def test_shares_leave_no_keyless_window(spark):
    fact = sales_table(spark, SF)
    for name in ("product_order_share", "revenue_by_category", "insights_category_breakdown"):
        plan = final_plan(catalog.REPORTS[name](fact))
        assert "Window" not in plan and "ReusedExchange" in plan


def test_distinct_values_are_in_no_list(spark):
    fact = sales_table(spark, SF)
    for name in ("dataset_summary", "insights_overview", "dimension_values"):
        assert "collect_" not in final_plan(catalog.REPORTS[name](fact))


def test_quartiles_read_only_the_ranges_that_hold_them(spark):
    fact = sales_table(spark, "/root/testdata/sf0.01")
    df = catalog.REPORTS["describe_numeric"](fact)
    plan = final_plan(df)
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "value_counts" in x]
    assert len(scans) == 2 and sum("dynamicpruning" in x for x in scans) == 1


def test_distinct_customers_need_no_distinct_aggregate(spark):
    fact = sales_table(spark, SF)
    plan = final_plan(catalog.REPORTS["customers_rollup"](fact))
    assert plan.count("Expand") == 1 and "distinct" not in plan.lower()
