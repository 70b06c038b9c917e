"""Per-dimension breakdowns of the EDA half.

EDA semantics: rows whose key is NULL are left out, a group's revenue is 0
when all its sales are NULL, "orders" counts non-NULL values of the measured
column.  Each ``present_*`` function formats a summary (``summaries``); the
public operators build that summary with one aggregate.  Ties in every
ordering go to the smaller key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions import fmt
from bazaar.functions.money import money_total, round_ratio
from bazaar.operators.summaries import dim_summary

SALES = "Total_Sales"


def by_revenue(summary: DataFrame, dim: str, ascending: bool = False) -> DataFrame:
    rev = F.col("_rev").asc() if ascending else F.col("_rev").desc()
    return summary.orderBy(rev, F.col(dim).asc())


def present_revenue_analysis(summary: DataFrame, dim: str) -> DataFrame:
    return by_revenue(summary, dim).select(
        dim,
        F.col("_rev").cast("double").alias("Total_Revenue"),
        round_ratio(F.col("_rev"), F.col("_n"), half_even=True).alias("Avg_Order"),
        F.col("_n").alias("Orders"),
        fmt.rupees(F.col("_rev")).alias("Total_Revenue_Text"),
        fmt.rupees_of_ratio(F.col("_rev"), F.col("_n")).alias("Avg_Order_Text"))


def category_analysis(df: DataFrame) -> DataFrame:
    """Revenue, mean sale and sale count per category, most revenue first."""
    return present_revenue_analysis(dim_summary(df, "Category"), "Category")


def city_analysis(df: DataFrame) -> DataFrame:
    """E5: revenue, mean sale and sale count per city, most revenue first."""
    return present_revenue_analysis(dim_summary(df, "City"), "City")


def present_product_analysis(summary: DataFrame) -> DataFrame:
    return by_revenue(summary, "Product").select(
        "Product", F.col("_rev").cast("double").alias("Revenue"), F.col("_units").alias("Units_Sold"),
        F.col("_ids").alias("Orders"), fmt.rupees(F.col("_rev")).alias("Revenue_Text"))


def product_analysis(df: DataFrame) -> DataFrame:
    """Revenue, units sold and order-id count per product, most revenue first."""
    return present_product_analysis(dim_summary(df, "Product"))


def present_chart_bars(summary: DataFrame, dim: str, ascending: bool) -> DataFrame:
    return by_revenue(summary, dim, ascending).select(
        dim, F.col("_rev").cast("double").alias("Revenue"), fmt.millions(F.col("_rev")).alias("Label"))


def chart_category_sales(df: DataFrame) -> DataFrame:
    """Bar data for revenue by category, smallest first, with ``Rs.x.xM`` labels."""
    return present_chart_bars(dim_summary(df, "Category"), "Category", ascending=True)


def chart_city_sales(df: DataFrame) -> DataFrame:
    """Bar data for revenue by city, largest first, with ``Rs.x.xM`` labels."""
    return present_chart_bars(dim_summary(df, "City"), "City", ascending=False)


def present_order_share(summary: DataFrame) -> DataFrame:
    # Denominator: a scalar subquery over the grouped rows.  Its aggregate is the same as the one
    # below it, so the exchange is reused and the fact is read once; no task gets all products.
    summary = summary.select("Product", "_rows")
    summary = summary.withColumn("_total", summary.select(F.sum("_rows")).scalar())
    total = F.col("_total")
    return (summary.orderBy(F.col("_rows").desc(), F.col("Product").asc())
                   .select("Product", F.col("_rows").alias("Orders"),
                           round_ratio(F.col("_rows"), total, scale=1,
                                       factor=100, half_even=True).alias("Share_Pct"),
                           fmt.percent(F.col("_rows"), total).alias("Share_Label")))


def product_order_share(df: DataFrame) -> DataFrame:
    """Orders per product and each product's share of all orders (donut data)."""
    return present_order_share(dim_summary(df, "Product"))


def present_category_breakdown(summary: DataFrame, total: Column) -> DataFrame:
    summary = summary.withColumn("_total", total)
    total = F.col("_total")
    return by_revenue(summary, "Category").select(
        "Category", F.col("_rev").cast("double").alias("Revenue"),
        fmt.number(F.col("_rev")).alias("Revenue_Text"),
        round_ratio(F.col("_rev"), total, scale=1, factor=100, half_even=True).alias("Share_Pct"))


def insights_category_breakdown(df: DataFrame) -> DataFrame:
    """Report table — revenue per category and its share of all revenue (one decimal).

    All revenue includes rows without a category, so the grouping keeps the
    NULL key.  The total is a scalar subquery over the grouped rows; both sides need the same two aggregates, so that the
    exchange is used again (a filter on the key itself would go down to one scan and make two).
    """
    g = df.groupBy("Category").agg(money_total(SALES).alias("_rev"), F.count("Category").alias("_named"))
    total = g.select(F.sum(F.when(F.col("_named") >= 0, F.col("_rev")))).scalar()
    return present_category_breakdown(g.withColumn("_all", total).where(F.col("_named") > 0), F.col("_all"))


def present_revenue_table(summary: DataFrame, dim: str) -> DataFrame:
    return by_revenue(summary, dim).select(
        dim, F.col("_rev").cast("double").alias("Revenue"), fmt.number(F.col("_rev")).alias("Revenue_Text"))


def insights_city_breakdown(df: DataFrame) -> DataFrame:
    """Report table — revenue per city, largest first."""
    return present_revenue_table(dim_summary(df, "City"), "City")


def insights_product_breakdown(df: DataFrame) -> DataFrame:
    """Report table — revenue per product, largest first."""
    return present_revenue_table(dim_summary(df, "Product"), "Product")
