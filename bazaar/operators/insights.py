"""KPI block and report overview.

Each is one scan of the fact: a GROUPING SETS rollup gives every summary the
row needs at once, and a single global aggregate over that small rollup picks
the totals, the arg-max keys (largest revenue, ties to the smaller key), the
numbers of keys and their sorted lists.  No joins, no driver round trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions import fmt
from bazaar.functions.money import money_total, round_ratio
from bazaar.operators.summaries import MONTH, grouping_code, key_list, rollup
from bazaar.operators.trends import month_label
from bazaar.schema import NAMED_CATEGORY

SALES = "Total_Sales"


class _Picks:
    """Conditional aggregates over a rollup of ``dims``."""

    def __init__(self, dims: list[str]):
        self.dims = dims

    def in_set(self, dim: str | None) -> Column:
        cond = F.col("_gid") == grouping_code(self.dims, dim)
        return cond if dim is None else cond & F.col(dim).isNotNull()

    def overall(self, c: str) -> Column:
        return F.max(F.when(self.in_set(None), F.col(c)))

    def top(self, dim: str) -> Column:
        """Struct ``(neg, key, rev)`` of the key with the largest revenue; ties to the smaller key."""
        return F.min(F.when(self.in_set(dim), F.struct((-F.col("_rev")).alias("neg"), F.col(dim).alias("key"),
                                                         F.col("_rev").alias("rev"))))

    def keys(self, dim: str) -> Column:
        """The number of keys; ``profile.dimension_values`` has them as rows."""
        return F.count_if(self.in_set(dim))

    def listed(self, dim: str) -> Column:
        return key_list(self.dims, dim)


KPI_DIMS = ["City", "Product"]
OVERVIEW_DIMS = ["Category", "City", "Product", MONTH]


def kpi_summary(df: DataFrame) -> DataFrame:
    """Total revenue, rows, revenue per row (all rows, NULL sales included), top product and city."""
    return present_kpis(rollup(df, KPI_DIMS), KPI_DIMS)


def present_kpis(r: DataFrame, dims: list[str]) -> DataFrame:
    p = _Picks(dims)
    row = r.agg(
        F.coalesce(p.overall("_rev"), F.lit(0).cast("decimal(24,2)")).alias("_rev"),
        F.coalesce(p.overall("_rows"), F.lit(0).cast("bigint")).alias("Total_Orders"),
        p.top("Product").alias("_tp"), p.top("City").alias("_tc"))
    return row.select(
        F.col("_rev").cast("double").alias("Total_Revenue"), "Total_Orders",
        round_ratio(F.col("_rev"), F.col("Total_Orders"), half_even=True).alias("Avg_Order_Value"),
        F.col("_tp.key").alias("Top_Product"), F.col("_tc.key").alias("Top_City"),
        fmt.rupees(F.col("_rev"), 2).alias("Total_Revenue_Text"),
        fmt.rupees_of_ratio(F.col("_rev"), F.col("Total_Orders"), 2).alias("Avg_Order_Value_Text"))


def insights_overview(df: DataFrame) -> DataFrame:
    """The report's overview and key findings as one row."""
    return present_overview(rollup(df, OVERVIEW_DIMS), OVERVIEW_DIMS)


def present_overview(r: DataFrame, dims: list[str]) -> DataFrame:
    p = _Picks(dims)
    row = r.agg(
        F.coalesce(p.overall("_rows"), F.lit(0).cast("bigint")).alias("Total_Records"),
        p.overall("_dmin").alias("Date_Min"), p.overall("_dmax").alias("Date_Max"),
        p.keys("City").alias("Cities"), p.keys("Category").alias("Categories"), p.keys("Product").alias("Products"),
        p.listed("City").alias("City_List"), p.listed("Category").alias("Category_List"), p.listed("Product").alias("Product_List"),
        F.coalesce(p.overall("_rev"), F.lit(0).cast("decimal(24,2)")).alias("_rev"),
        p.top("Category").alias("_tcat"), p.top("City").alias("_tcity"), p.top("Product").alias("_tprod"),
        p.top(MONTH).alias("_tmonth"))
    return row.select(
        "Total_Records", "Date_Min", "Date_Max",
        "Cities", "City_List", "Categories", "Category_List", "Products", "Product_List",
        F.col("_rev").cast("double").alias("Total_Revenue"),
        round_ratio(F.col("_rev"), F.col("Total_Records"), half_even=True).alias("Avg_Order_Value"),
        F.col("_tcat.key").alias("Top_Category"),
        F.col("_tcat.rev").cast("double").alias("Top_Category_Revenue"),
        round_ratio(F.col("_tcat.rev"), F.col("_rev"), scale=1, factor=100,
                    half_even=True).alias("Top_Category_Share_Pct"),
        F.col("_tcity.key").alias("Top_City"), F.col("_tcity.rev").cast("double").alias("Top_City_Revenue"),
        F.col("_tprod.key").alias("Top_Product"), F.col("_tprod.rev").cast("double").alias("Top_Product_Revenue"),
        month_label(F.col("_tmonth.key"), "MMMM").alias("Best_Month"),
        fmt.rupees(F.col("_rev"), 2).alias("Total_Revenue_Text"),
        fmt.rupees_of_ratio(F.col("_rev"), F.col("Total_Records"), 2).alias("Avg_Order_Value_Text"),
        fmt.millions(F.col("_rev"), 2, suffix=" Million").alias("Total_Revenue_Millions"),
        fmt.rupees_of_ratio(F.col("_rev"), F.col("Total_Records"), 0).alias("Avg_Order_Value_Whole"),
        fmt.millions(F.col("_tcat.rev"), 2).alias("Top_Category_Revenue_Text"),
        fmt.millions(F.col("_tcity.rev"), 2).alias("Top_City_Revenue_Text"),
        fmt.millions(F.col("_tprod.rev"), 2).alias("Top_Product_Revenue_Text"))


def named_category_share(df: DataFrame, category: str = NAMED_CATEGORY) -> DataFrame:
    """Revenue of one named category and its share of all revenue; 0 when absent.

    One global aggregate with a conditional sum — no grouping, no shuffle by key.
    """
    row = df.agg(money_total(F.when(F.col("Category") == category, F.col(SALES))).alias("_cat"),
                 money_total(SALES).alias("_all"))
    return present_named_share(row, category)


def present_named_share(row: DataFrame, category: str = NAMED_CATEGORY) -> DataFrame:
    """From a one-row frame with ``_cat`` (the category's revenue) and ``_all`` (all revenue)."""
    return row.select(
        F.lit(category).alias("Category"), F.col("_cat").cast("double").alias("Revenue"),
        round_ratio(F.col("_cat"), F.col("_all"), scale=1, factor=100,
                    half_even=True).alias("Share_Pct"),
        fmt.percent(F.col("_cat"), F.col("_all")).alias("Share_Label"))
