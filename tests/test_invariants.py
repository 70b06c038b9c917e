"""Invariants on generated sales tables (hypothesis), each checked with a few Spark jobs."""

from datetime import date, timedelta
from decimal import Decimal

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaar.operators import bands, breakdowns, distribution, reports
from bazaar.schema import SALES_SCHEMA
from rows import row

rows = st.lists(st.builds(
    lambda city, cat, cents, age, day: row(City=city, Category=cat, Product=cat + "-p",
                                           Total_Sales=None if cents is None else Decimal(cents).scaleb(-2),
                                           Age=age, Order_Date=date(2025, 1, 1) + timedelta(days=day)),
    st.sampled_from(["Pune", "Gaya", "Delhi", None]), st.sampled_from(["A", "B", "C"]),
    st.one_of(st.none(), st.integers(0, 10**9)), st.one_of(st.none(), st.integers(-5, 95)),
    st.integers(0, 500)), min_size=1, max_size=60)


@settings(max_examples=4, deadline=None, phases=[Phase.generate])
@given(rows)
def test_breakdowns_and_shares(spark, data):
    df = spark.createDataFrame(data, SALES_SCHEMA)
    total = reports.total_revenue(df).first().Total_Revenue_INR or 0.0
    cat = reports.revenue_by_category(df).collect()
    assert abs(sum(r.Total_Revenue_INR or 0.0 for r in cat) - total) < 1e-6
    if total:
        # A group whose sales are all NULL has a NULL share (SQL semantics).
        assert abs(sum(r.Revenue_Share_Pct or 0.0 for r in cat) - 100) <= 0.005 * len(cat) + 1e-9
    keyed = df.where(F.col("City").isNotNull())
    e = breakdowns.city_analysis(keyed).collect()
    assert abs(sum(r.Total_Revenue for r in e) - (reports.total_revenue(keyed).first().Total_Revenue_INR or 0)) < 1e-6
    assert sum(r.Total_Orders for r in reports.revenue_by_city(df).collect()) == len(data)


@settings(max_examples=4, deadline=None, phases=[Phase.generate])
@given(rows)
def test_distribution_invariants(spark, data):
    df = spark.createDataFrame(data, SALES_SCHEMA)
    ages = [r[4] for r in data if r[4] is not None]
    hist = distribution.age_histogram(df).collect()
    assert sum(r.Orders for r in hist) == len(ages)
    dens = distribution.age_density(df).orderBy("Point").collect()
    if dens:
        assert all(r.Density >= 0 for r in dens)
        step = dens[1].X - dens[0].X
        assert sum(r.Density for r in dens) * step <= 1 + 1e-6
    in_range = sum(1 for a in ages if 0 <= a < 70)
    assert sum(r.Orders for r in bands.age_band_counts(df).collect()) == in_range


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(rows, st.integers(1, 7))
def test_partitioning_does_not_change_results(spark, data, parts):
    df = spark.createDataFrame(data, SALES_SCHEMA)
    for op in (reports.revenue_by_city, breakdowns.category_analysis, reports.age_band_revenue):
        assert sorted(op(df).collect(), key=repr) == sorted(op(df.repartition(parts)).collect(), key=repr)
