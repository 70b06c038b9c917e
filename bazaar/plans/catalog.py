"""Catalog of registered queries: key -> ``(spark, sf_dir) -> DataFrame``.

Report queries run over the materialised sales table (``sales_table``), the
way the reference's reports run over its loaded table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.functions.text import with_collation
from bazaar.operators import bands, breakdowns, customers, distribution, insights, profile, reports, trends
from bazaar.sources.tables import sales_table

Query = Callable[[SparkSession, str], DataFrame]


def on_sales(op: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(sales_table(spark, sf_dir))
    run.__name__ = getattr(op, "__name__", "query")
    run.__doc__ = op.__doc__
    return run


def revenue_by_city_ci(df: DataFrame) -> DataFrame:
    """Q5 under the database's collation: cities written in different case are one group."""
    mixed = df.withColumn("City", F.when(F.col("Quantity") % 2 == 0, F.lower("City")).otherwise(F.col("City")))
    out = reports.revenue_by_city(with_collation(mixed, ["City"]))
    return out.withColumn("City", F.upper(F.collate("City", "UTF8_BINARY")))


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "total_revenue": reports.total_revenue,
    "average_order_value": reports.average_order_value,
    "top_products": reports.top_products,
    "revenue_by_category": reports.revenue_by_category,
    "revenue_by_city": reports.revenue_by_city,
    "revenue_by_city_ci": revenue_by_city_ci,
    "monthly_revenue": reports.monthly_revenue,
    "product_quantity": reports.product_quantity,
    "revenue_by_gender": reports.revenue_by_gender,
    "age_band_revenue": reports.age_band_revenue,
    "city_category_matrix": reports.city_category_matrix,
    "dataset_summary": profile.dataset_summary,
    "dimension_values": profile.dimension_values,
    "missing_values": profile.missing_values,
    "describe_numeric": profile.describe_numeric,
    "category_analysis": breakdowns.category_analysis,
    "city_analysis": breakdowns.city_analysis,
    "product_analysis": breakdowns.product_analysis,
    "month_of_year_trend": trends.month_of_year_trend,
    "age_band_counts": bands.age_band_counts,
    "chart_category_sales": breakdowns.chart_category_sales,
    "chart_city_sales": breakdowns.chart_city_sales,
    "product_order_share": breakdowns.product_order_share,
    "age_histogram": distribution.age_histogram,
    "age_density": distribution.age_density,
    "sales_density": distribution.sales_density,
    "customers_rollup": customers.customers_rollup,
    "chart_monthly_trend": trends.chart_monthly_trend,
    "kpi_summary": insights.kpi_summary,
    "insights_overview": insights.insights_overview,
    "insights_category_breakdown": breakdowns.insights_category_breakdown,
    "insights_city_breakdown": breakdowns.insights_city_breakdown,
    "insights_product_breakdown": breakdowns.insights_product_breakdown,
    "named_category_share": insights.named_category_share,
}


def queries() -> dict[str, Query]:
    from bazaar.plans import ingest
    out: dict[str, Query] = {k: on_sales(op) for k, op in REPORTS.items()}
    out.update(ingest.QUERIES)
    return out
