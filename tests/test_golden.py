"""Replay of the published report's product totals (FIXTURES §2)."""

from decimal import Decimal

from bazaar.operators import breakdowns, insights, reports
from rows import row

GOLDEN = [("Laptop", "Electronics", 25443009), ("Mobile", "Electronics", 25335573),
          ("Book", "Education", 25031689), ("Rice", "Grocery", 22231711),
          ("Chair", "Furniture", 21521561), ("Shoes", "Fashion", 19835896)]


def test_golden_shares(sales):
    df = sales(*[row(Product=p, Category=c, Total_Sales=Decimal(v)) for p, c, v in GOLDEN])
    shares = {r.Category: r.Share_Pct for r in breakdowns.insights_category_breakdown(df).collect()}
    assert shares == {"Electronics": 36.4, "Education": 18.0, "Grocery": 15.9, "Furniture": 15.4,
                      "Fashion": 14.2}
    assert reports.total_revenue(df).collect()[0].Total_Revenue_INR == 139399439.0
    o = insights.insights_overview(df).collect()[0]
    assert (o.Top_Category, o.Top_Product) == ("Electronics", "Laptop")
    assert insights.named_category_share(df).collect()[0].Share_Label == "36.4%"


def test_formatting(sales):
    df = sales(row(Category="A", Total_Sales=Decimal("2.50")), row(Category="B", Total_Sales=Decimal("1234567.50")))
    text = {r.Category: r.Total_Revenue_Text for r in breakdowns.category_analysis(df).collect()}
    assert text == {"A": "Rs.2", "B": "Rs.1,234,568"}
