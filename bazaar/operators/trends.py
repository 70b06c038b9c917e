"""Month-of-year revenue (E7) and its chart data.

Years are merged and every month 1–12 appears, zero-filled; undated rows are
left out.  The month summary has at most twelve rows, so the zero fill is a
tiny conditional aggregate over it unpacked with ``inline`` — no scaffold
join.  (Q6, the year-and-month trend, is in ``reports``.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions import fmt
from bazaar.operators.summaries import MONTH, dim_summary


def month_label(month_num: Column, pattern: str = "MMM") -> Column:
    """``Jan`` … ``Dec`` (``MMMM``: ``January`` …) for a month number."""
    return F.date_format(F.make_date(F.lit(2000), month_num, F.lit(1)), pattern)


def twelve_months(month_summary: DataFrame) -> DataFrame:
    """``(Month_Num, _rev)`` for months 1–12, 0 where the summary has no row."""
    wide = month_summary.agg(*[F.max(F.when(F.col(MONTH) == i, F.col("_rev"))).alias(f"m{i}")
                               for i in range(1, 13)])
    rows = F.array(*[F.struct(F.lit(i).alias(MONTH), F.col(f"m{i}").alias("_rev")) for i in range(1, 13)])
    zero = F.lit(0).cast("decimal(24,2)")
    return wide.select(F.inline(rows)).select(MONTH, F.coalesce(F.col("_rev"), zero).alias("_rev"))


def present_month_trend(month_summary: DataFrame) -> DataFrame:
    return twelve_months(month_summary).select(
        MONTH, month_label(F.col(MONTH)).alias("Month"),
        F.col("_rev").cast("double").alias("Revenue"), fmt.rupees(F.col("_rev")).alias("Revenue_Text"))


def month_of_year_trend(df: DataFrame) -> DataFrame:
    """Revenue per month of year, ``Jan`` … ``Dec``, zero-filled."""
    return present_month_trend(dim_summary(df, MONTH))


def present_month_chart(month_summary: DataFrame) -> DataFrame:
    return twelve_months(month_summary).select(
        (F.col(MONTH) - 1).alias("Position"), month_label(F.col(MONTH)).alias("Month"),
        F.col("_rev").cast("double").alias("Revenue"), fmt.millions(F.col("_rev")).alias("Label"))


def chart_monthly_trend(df: DataFrame) -> DataFrame:
    """Line-chart points — x position 0–11, month label, revenue, ``Rs.x.xM`` annotation."""
    return present_month_chart(dim_summary(df, MONTH))
