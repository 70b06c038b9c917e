"""Driver contract and breakdown invariants on the smallest test tables."""

import importlib

from pyspark.sql import functions as F

from bazaar.operators import breakdowns, reports
from bazaar.sources.tables import sales_table

E = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    from bazaar.plans import catalog
    assert set(catalog.queries()) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_breakdowns_sum_to_total(spark):
    df = sales_table(spark, SF)
    total = reports.total_revenue(df).collect()[0].Total_Revenue_INR
    for op, col in [(reports.revenue_by_category, "Total_Revenue_INR"), (reports.revenue_by_city, "Total_Revenue_INR")]:
        assert abs(op(df).agg(F.sum(col)).collect()[0][0] - total) < 1e-6
    # The EDA breakdowns leave rows without a key out.
    named = reports.total_revenue(df.where("Product is not null")).collect()[0].Total_Revenue_INR
    assert named < total
    assert abs(breakdowns.insights_product_breakdown(df).agg(F.sum("Revenue")).collect()[0][0] - named) < 1e-6


def test_partition_count_does_not_matter(spark):
    df = sales_table(spark, SF)
    a = reports.revenue_by_city(df).collect()
    b = reports.revenue_by_city(df.repartition(7)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_approximate_customer_count_is_close(spark):
    df = sales_table(spark, SF)
    exact = {r.City: r.Unique_Customers for r in reports.revenue_by_city(df).collect()}
    approx = {r.City: r.Unique_Customers for r in reports.revenue_by_city(df, approx_customers=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[c] - exact[c]) <= max(2, 0.05 * exact[c]) for c in exact)


def test_scale_conf_sizes_partitions():
    from bazaar.session import scale_conf
    conf = scale_conf(100 << 40)
    assert int(conf["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20) == 409600
    assert scale_conf(1 << 20)["spark.sql.shuffle.partitions"] == "200"
