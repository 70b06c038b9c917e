"""The ten business reports of the SQL half (Q1–Q10).

SQL semantics throughout: NULL group keys form their own group, ``COUNT(*)``
counts rows, averages skip NULLs, an all-NULL sum is NULL.  Money is summed in
DECIMAL and rounded exactly (see ``bazaar.functions.money``).  Every report is a
single scan with a partial (map-side) aggregate before the shuffle, so the
shuffle carries one row per group per partition whatever the skew of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.money import avg_money, round_ratio
from bazaar.schema import SQL_AGE_BANDS

SALES = "Total_Sales"


def revenue(c: str = SALES) -> Column:
    """``ROUND(SUM(c), 2)`` — the DECIMAL sum already has two places."""
    return F.sum(c).cast("double")


def row_count() -> Column:
    return F.count(F.lit(1))


def total_revenue(df: DataFrame) -> DataFrame:
    """Q1: revenue and order count over the whole table."""
    return df.agg(revenue().alias("Total_Revenue_INR"), row_count().alias("Total_Orders"))


def average_order_value(df: DataFrame) -> DataFrame:
    """Q2: mean sale over the non-NULL sales."""
    return df.agg(avg_money(SALES).alias("Average_Order_Value_INR"))


def top_products(df: DataFrame, k: int = 5) -> DataFrame:
    """Q3: the ``k`` products with the most revenue; ties go to the smaller name."""
    g = df.groupBy("Product").agg(
        F.sum(SALES).alias("_rev"),
        F.sum("Quantity").alias("Total_Units_Sold"),
        row_count().alias("Total_Orders"))
    return (g.orderBy(F.col("_rev").desc_nulls_last(), F.col("Product").asc_nulls_first())
             .limit(k)
             .select("Product", F.col("_rev").cast("double").alias("Total_Revenue_INR"),
                     "Total_Units_Sold", "Total_Orders"))


def revenue_by_category(df: DataFrame) -> DataFrame:
    """Q4: revenue, mean sale, orders and share of all revenue per category.

    The share's denominator is the sum of the *grouped* rows (NULL category
    included, as in SQL), taken as a scalar subquery over that one-row-per-category
    result.  It sums every column of the result, so that its aggregate is the same and
    the exchange is reused: the fact is scanned once.
    """
    g = df.groupBy("Category").agg(
        F.sum(SALES).alias("_rev"), F.count(SALES).alias("_n"), row_count().alias("Total_Orders"))
    sums = g.select(F.struct(*[F.sum(c).alias(c) for c in ("_rev", "_n", "Total_Orders")])).scalar()
    g = g.withColumn("_sums", sums).withColumn("_total", F.col("_sums._rev"))
    return (g.select(
        "Category",
        F.col("_rev").cast("double").alias("Total_Revenue_INR"),
        round_ratio(F.col("_rev"), F.col("_n")).alias("Avg_Order_Value_INR"),
        "Total_Orders",
        round_ratio(F.col("_rev"), F.col("_total"), factor=100).alias("Revenue_Share_Pct"),
        F.col("_rev").alias("_sort"))
        .orderBy(F.col("_sort").desc_nulls_last(), F.col("Category").asc_nulls_first())
        .drop("_sort"))


def revenue_by_city(df: DataFrame, approx_customers: bool = False) -> DataFrame:
    """Q5: revenue, mean sale, orders and distinct customers per city.

    The exact distinct count is a two-level aggregate whose first level is keyed
    on ``(City, Customer_ID)``: its shuffle grows with the number of customers.
    ``approx_customers=True`` uses a HyperLogLog sketch per city instead (about 1%
    relative error), which shuffles one small sketch per city per task.
    """
    customers = (F.approx_count_distinct("Customer_ID", 0.01) if approx_customers
                 else F.count_distinct("Customer_ID"))
    g = df.groupBy("City").agg(
        F.sum(SALES).alias("_rev"), F.count(SALES).alias("_n"), row_count().alias("Total_Orders"),
        customers.alias("Unique_Customers"))
    return (g.orderBy(F.col("_rev").desc_nulls_last(), F.col("City").asc_nulls_first())
             .select("City", F.col("_rev").cast("double").alias("Total_Revenue_INR"),
                     round_ratio(F.col("_rev"), F.col("_n")).alias("Avg_Order_Value_INR"),
                     "Total_Orders", "Unique_Customers"))


def monthly_revenue(df: DataFrame) -> DataFrame:
    """Q6: revenue and orders per calendar month (year kept), dated rows only.

    The label is part of the grouping key (it is a function of year and month).
    """
    d = F.col("Order_Date")
    g = (df.where(d.isNotNull())
           .groupBy(F.year(d).alias("Year"), F.month(d).alias("Month_Num"),
                    F.date_format(d, "MMM yyyy").alias("Month_Label"))
           .agg(revenue().alias("Monthly_Revenue_INR"), row_count().alias("Orders_Count")))
    return g.orderBy("Year", "Month_Num")


def product_quantity(df: DataFrame) -> DataFrame:
    """Q7: units, revenue and mean unit price per product, most units first."""
    g = df.groupBy("Product").agg(
        F.sum("Quantity").alias("Total_Quantity_Sold"),
        F.sum(SALES).alias("_rev"),
        avg_money("Unit_Price").alias("Avg_Unit_Price_INR"))
    return (g.orderBy(F.col("Total_Quantity_Sold").desc_nulls_last(), F.col("Product").asc_nulls_first())
             .select("Product", "Total_Quantity_Sold",
                     F.col("_rev").cast("double").alias("Total_Revenue_INR"), "Avg_Unit_Price_INR"))


def revenue_by_gender(df: DataFrame) -> DataFrame:
    """Q8: orders, revenue and mean sale per gender."""
    g = df.groupBy("Gender").agg(
        row_count().alias("Total_Orders"), F.sum(SALES).alias("_rev"), F.count(SALES).alias("_n"))
    return (g.orderBy(F.col("_rev").desc_nulls_last(), F.col("Gender").asc_nulls_first())
             .select("Gender", "Total_Orders", F.col("_rev").cast("double").alias("Total_Revenue_INR"),
                     round_ratio(F.col("_rev"), F.col("_n")).alias("Avg_Order_Value_INR")))


def sql_age_band(age: Column) -> Column:
    """The SQL CASE bands: ``< 20``, four closed decades, everything else ``60+``."""
    under, b20, b30, b40, b50, rest = SQL_AGE_BANDS
    return (F.when(age < 20, under)
             .when(age.between(20, 29), b20)
             .when(age.between(30, 39), b30)
             .when(age.between(40, 49), b40)
             .when(age.between(50, 59), b50)
             .otherwise(rest))


def age_band_revenue(df: DataFrame) -> DataFrame:
    """Q9: orders, revenue and mean sale per SQL age band, youngest band first."""
    g = (df.where(F.col("Age").isNotNull())
           .groupBy(sql_age_band(F.col("Age")).alias("Age_Group"))
           .agg(row_count().alias("Total_Orders"), F.sum(SALES).alias("_rev"),
                F.count(SALES).alias("_n"), F.min("Age").alias("_min_age")))
    return (g.orderBy("_min_age")
             .select("Age_Group", "Total_Orders", F.col("_rev").cast("double").alias("Total_Revenue_INR"),
                     round_ratio(F.col("_rev"), F.col("_n")).alias("Avg_Order_Value_INR")))


def city_category_matrix(df: DataFrame) -> DataFrame:
    """Q10: revenue and orders per (city, category), long form."""
    g = df.groupBy("City", "Category").agg(F.sum(SALES).alias("_rev"), row_count().alias("Orders"))
    return (g.orderBy(F.col("City").asc_nulls_first(), F.col("_rev").desc_nulls_last())
             .select("City", "Category", F.col("_rev").cast("double").alias("Revenue_INR"), "Orders"))
