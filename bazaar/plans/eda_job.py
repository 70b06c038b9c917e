"""The EDA job (E20) and its sinks.

The fact is read once.  ``summaries.full_rollup`` is one Expand and one aggregate over all rows: GROUPING SETS of
(Category), (City), (Product), (month), each profiled numeric column, and (), with revenue, counts, units, the date range
and the NULL counts.  Its result, one row per key and set, is written below the shared folder with a
folder per set, and every section is cut from that table: the analyses, chart data, KPIs and report tables from the
dimension sets, the summary and NULL counts from the overall row and the NULL keys, bands, histogram and density from
the set of ages, describe from the sets of the numeric columns (which ``quantiles.ranged`` deals into ranges).
Sections are returned as lazy DataFrames; ``write_sections`` stores each as Parquet (the report and the
chart data — the images themselves are not rendered).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.operators import bands, breakdowns, distribution, insights, profile, trends
from bazaar.operators.summaries import (MONTH, from_rollup, full_rollup, missing_from_rollup, overall_from_rollup,
                                        values_from_rollup)
from bazaar.schema import DIMENSIONS, NAMED_CATEGORY, NUMERIC_PROFILE_COLUMNS
from bazaar.session import shared_path


def shared_rollup(fact: DataFrame) -> tuple[DataFrame, list[str]]:
    """``full_rollup`` written (the job's only read of the fact), and its keys."""
    r, keys = full_rollup(fact)
    path = shared_path(fact.sparkSession, "eda_rollup", uuid.uuid4().hex)
    r.write.partitionBy("_gid").parquet(path)
    return fact.sparkSession.read.schema(r.schema).parquet(path), keys


def section_builders(columns: list[str], r: DataFrame, keys: list[str]) -> dict[str, Callable[[], DataFrame]]:
    """Name -> zero-argument builder of each section of a fact with ``columns``; ``r`` is its written rollup by ``keys``."""
    cat, city, prod, month = (from_rollup(r, d, keys) for d in ("Category", "City", "Product", MONTH))
    ages = values_from_rollup(r, "Age", keys)

    def values() -> DataFrame:
        kind = profile.long_type(r, [f"_v_{c}" for c in NUMERIC_PROFILE_COLUMNS])
        parts = [values_from_rollup(r, c, keys).select(F.lit(i).alias("_k"), F.col("v").cast(kind).alias("v"), "c")
                 for i, c in enumerate(NUMERIC_PROFILE_COLUMNS)]
        return reduce(DataFrame.unionByName, parts)

    def keys_of_dimensions() -> DataFrame:
        parts = [from_rollup(r, d, keys).select(F.lit(d).alias("Dimension"), F.col(d).cast("string").alias("Value")) for d in DIMENSIONS]
        return reduce(DataFrame.unionByName, parts)

    def total() -> Column:
        return overall_from_rollup(r, keys).select(F.col("_rev")).scalar()

    def named() -> DataFrame:
        cat_rev = cat.agg(F.coalesce(F.sum(F.when(F.col("Category") == NAMED_CATEGORY, F.col("_rev"))),
                                     F.lit(0).cast("decimal(24,2)")).alias("_cat"))
        return insights.present_named_share(cat_rev.select("_cat", total().alias("_all")))

    return {
        "dataset_summary": lambda: profile.present_summary(r, keys, columns),
        "dimension_values": lambda: profile.present_values(keys_of_dimensions()),
        "missing_values": lambda: profile.present_missing(missing_from_rollup(r, columns, keys), columns),
        "describe_numeric": lambda: profile.describe_counted(values(), NUMERIC_PROFILE_COLUMNS),
        "category_analysis": lambda: breakdowns.present_revenue_analysis(cat, "Category"),
        "city_analysis": lambda: breakdowns.present_revenue_analysis(city, "City"),
        "product_analysis": lambda: breakdowns.present_product_analysis(prod),
        "month_of_year_trend": lambda: trends.present_month_trend(month),
        "age_band_counts": lambda: bands.present_band_counts(bands.bands_of_counts(ages)),
        "chart_category_sales": lambda: breakdowns.present_chart_bars(cat, "Category", ascending=True),
        "chart_city_sales": lambda: breakdowns.present_chart_bars(city, "City", ascending=False),
        "product_order_share": lambda: breakdowns.present_order_share(prod),
        "age_histogram": lambda: distribution.histogram_from_counts(ages),
        "age_density": lambda: distribution.density_from_counts(ages),
        "chart_monthly_trend": lambda: trends.present_month_chart(month),
        "insights_overview": lambda: insights.present_overview(r, keys),
        "insights_category_breakdown": lambda: breakdowns.present_category_breakdown(cat, total()),
        "insights_city_breakdown": lambda: breakdowns.present_revenue_table(city, "City"),
        "insights_product_breakdown": lambda: breakdowns.present_revenue_table(prod, "Product"),
        "named_category_share": named,
        "kpi_summary": lambda: insights.present_kpis(r, keys),
    }


def sections(fact: DataFrame, cache: bool = True) -> dict[str, DataFrame]:
    """Every section; with ``cache=False`` the rollup is not written, and each section that is run reads the fact for itself."""
    r, keys = shared_rollup(fact) if cache else full_rollup(fact)
    return {name: build() for name, build in section_builders(fact.columns, r, keys).items()}


def write_sections(secs: dict[str, DataFrame], out_dir: str, parallelism: int = 4) -> None:
    """One Parquet dataset per section."""
    def write(item):
        name, df = item
        df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(write, secs.items()))


def run(fact: DataFrame, out_dir: str | None = None, generated_at: datetime | None = None,
        parallelism: int = 4) -> dict[str, DataFrame]:
    """Build every section and write it, ``parallelism`` jobs at a time; returns the written sections.

    The sections are independent small jobs on the written rollup, so
    they are submitted concurrently from a thread pool and share the cluster.
    They go below ``out_dir`` (a new shared folder if none is given), with the Markdown report when
    ``generated_at`` is given.  Nothing is collected.
    """
    out_dir = (out_dir or shared_path(fact.sparkSession, "eda", uuid.uuid4().hex)).rstrip("/")
    builders = section_builders(fact.columns, *shared_rollup(fact))
    # Building a plan is driver-side analysis that does not gain from threads, so
    # plans are built one after another and only their execution is concurrent.
    # Two sections run Spark jobs while they are built (they write tables of ranges), so
    # these builds are started on the pool first.
    with ThreadPoolExecutor(parallelism) as pool:
        eager = {n: pool.submit(builders[n]) for n in ("describe_numeric", "dimension_values")}
        secs = {n: (eager[n] if n in eager else b()) for n, b in builders.items()}
        secs = {n: (v.result() if n in eager else v) for n, v in secs.items()}
    write_sections(secs, out_dir, parallelism)
    if generated_at is not None:
        from bazaar.plans.report import write_report
        write_report(secs, f"{out_dir}/report", generated_at)
    read = fact.sparkSession.read
    return {name: read.schema(df.schema).parquet(f"{out_dir}/{name}") for name, df in secs.items()}
