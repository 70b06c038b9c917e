"""SQL-half and EDA-half semantics on edge rows (FIXTURES §4)."""

from datetime import date

from pyspark.sql import functions as F

from bazaar.functions.text import with_collation
from bazaar.operators import bands, breakdowns, insights, reports, trends
from rows import row


def as_dict(df, key):
    return {r[key]: r for r in df.collect()}


def test_null_city_kept_in_sql_dropped_in_eda(sales):
    df = sales(row(City=None), row(City="Pune"))
    assert None in as_dict(reports.revenue_by_city(df), "City")
    assert None not in as_dict(breakdowns.city_analysis(df), "City")


def test_null_sales_counts_and_averages(sales):
    df = sales(row(Total_Sales=10), row(Total_Sales=20), row(Total_Sales=None))
    q = reports.revenue_by_category(df).collect()[0]
    assert q.Total_Orders == 3 and q.Avg_Order_Value_INR == 15.0
    e = breakdowns.category_analysis(df).collect()[0]
    assert e.Orders == 2 and e.Avg_Order == 15.0
    k = insights.kpi_summary(df).collect()[0]
    assert k.Total_Orders == 3 and k.Avg_Order_Value == 10.0


def test_all_null_group(sales):
    df = sales(row(Category="A", Total_Sales=None), row(Category="B", Total_Sales=5))
    assert as_dict(reports.revenue_by_category(df), "Category")["A"].Total_Revenue_INR is None
    assert as_dict(breakdowns.category_analysis(df), "Category")["A"].Total_Revenue == 0.0


def test_age_bands_both_halves(sales):
    ages = [-1, 0, 19, 20, 69, 70, 80, None]
    df = sales(*[row(Age=a) for a in ages])
    q = {r.Age_Group: r.Total_Orders for r in reports.age_band_revenue(df).collect()}
    assert q == {"Under 20": 3, "20 – 29": 1, "60+": 3}
    e = [(r.Age_Band, r.Orders) for r in bands.age_band_counts(df).orderBy("Band_Index").collect()]
    assert e == [("<20", 2), ("20-29", 1), ("30-39", 0), ("40-49", 0), ("50-59", 0), ("60+", 1)]


def test_month_keys(sales):
    df = sales(row(Order_Date=date(2025, 1, 10)), row(Order_Date=date(2026, 1, 10)))
    assert reports.monthly_revenue(df).count() == 2
    t = trends.month_of_year_trend(df).orderBy("Month_Num").collect()
    assert len(t) == 12 and t[0].Month == "Jan" and t[0].Revenue == 20.0
    assert all(r.Revenue == 0.0 for r in t[1:])


def test_top_one_tie_goes_to_smaller_name(sales):
    df = sales(row(Product="Zeta", City="Y"), row(Product="Alpha", City="X"))
    k = insights.kpi_summary(df).collect()[0]
    assert k.Top_Product == "Alpha" and k.Top_City == "X"
    assert reports.top_products(df, 1).collect()[0].Product == "Alpha"


def test_case_insensitive_grouping_is_opt_in(sales):
    df = sales(row(City="Pune"), row(City="PUNE"), row(City="Pune", Category="Électronique"),
               row(City="Delhi", Category="electronique"))
    assert reports.revenue_by_city(df).count() == 3
    folded = with_collation(df, ["City", "Category"])
    assert {r.Total_Orders for r in reports.revenue_by_city(folded).collect()} == {3, 1}
    assert reports.revenue_by_category(folded).count() == 2


def test_empty_table(sales):
    df = sales()
    q1 = reports.total_revenue(df).collect()[0]
    assert q1.Total_Revenue_INR is None and q1.Total_Orders == 0
    assert reports.average_order_value(df).collect()[0][0] is None
    k = insights.kpi_summary(df).collect()[0]
    assert k.Total_Orders == 0 and k.Avg_Order_Value is None


def test_share_and_rounding(sales):
    df = sales(row(Category="A", Total_Sales=1), row(Category="B", Total_Sales=2))
    shares = {r.Category: r.Revenue_Share_Pct for r in reports.revenue_by_category(df).collect()}
    assert shares == {"A": 33.33, "B": 66.67}


def test_named_category_absent_is_zero(sales):
    r = insights.named_category_share(sales(row(Category="Books"))).collect()[0]
    assert r.Revenue == 0.0 and r.Share_Pct == 0.0


def test_dataset_summary_counts_and_values_as_rows(sales):
    from bazaar.operators.profile import dataset_summary, dimension_values
    df = sales(row(City="Pune"), row(City="Gaya"), row(City=None), row(City="Pune", Category=None))
    summary = dataset_summary(df).first()
    assert (summary.Rows, summary.Cities, summary.Categories, summary.Products) == (4, 2, 1, 1)
    values = dimension_values(df).collect()
    assert sorted(map(tuple, values)) == [("Category", 1, "Electronics"), ("City", 1, "Gaya"), ("City", 2, "Pune"), ("Product", 1, "Laptop")]
    empty = dataset_summary(sales()).first()
    assert (empty.Rows, empty.Cities, empty.Date_Min) == (0, 0, None) and dimension_values(sales()).collect() == []


def test_dataset_summary_lists_every_value_in_order(sales):
    from bazaar.operators.profile import dataset_summary
    df = sales(row(City="Pune"), row(City="Gaya", Product="b, c"), row(City=None), row(City="Pune", Category=None, Product="Z"))
    r = dataset_summary(df).first()
    assert (r.City_List, r.Category_List, r.Product_List) == ("Gaya, Pune", "Electronics", "Laptop, Z, b, c")
    empty = dataset_summary(sales()).first()
    assert (empty.City_List, empty.Category_List, empty.Product_List) == (None, None, None)


def test_overview_lists_every_value_in_order(sales):
    df = sales(row(City="Pune"), row(City="Gaya"), row(City=None, Category="A"), row(City="Pune", Category=None, Product="Z"))
    r = insights.insights_overview(df).first()
    assert (r.City_List, r.Category_List, r.Product_List) == ("Gaya, Pune", "A, Electronics", "Laptop, Z")


def test_dimension_values_number_through_ranges(sales):
    from bazaar.operators.profile import dimension_values
    cities = [f"C{i * 7919 % 1000:04d}" for i in range(1000)]
    got = dimension_values(sales(*[row(City=c) for c in cities]), ["City"]).collect()
    assert sorted((r.Position, r.Value) for r in got) == list(enumerate(sorted(cities), 1))


def test_named_share_without_revenue(sales):
    r = insights.named_category_share(sales(row(Category="Electronics", Total_Sales=None))).first()
    assert (r.Revenue, r.Share_Pct, r.Share_Label) == (0.0, None, None)
    r = insights.named_category_share(sales()).first()
    assert (r.Revenue, r.Share_Pct) == (0.0, None)
