"""Report sink (A13): the report's computed tables as Markdown lines, written by Spark.

Only computed content is produced — the generation stamp, the overview table, the key
findings, the category, city and product revenue tables — never the fixed prose around
them.  Lines
are built with column functions from the section DataFrames (one row per
key); each line carries its sort key (table, header row, revenue, key), and
the writer orders them with a range-partitioned sort — no numbering in one
task — and writes the sorted part files.  ``single_file=True`` gathers them in one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.functions import fmt


ORDER = ["Table", "Part", "Row", "_desc", "_key"]


def _table(df: DataFrame, table: int, key: str, header: list[str], cells) -> DataFrame:
    """Header lines (part 0) and one line per row of ``df`` (part 1, largest revenue first, then key)."""
    spark = df.sparkSession
    head = spark.createDataFrame([(table, 0, i, None, None, line) for i, line in enumerate(header)],
                                 "Table int, Part int, Row int, _desc double, _key string, Line string")
    body = df.select(F.lit(table).alias("Table"), F.lit(1).alias("Part"), F.lit(0).alias("Row"),
                     (-F.col("Revenue")).alias("_desc"), F.col(key).cast("string").alias("_key"),
                     F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("Line"))
    return head.unionByName(body)


# Labels and layout of the report's computed lines, in order.
OVERVIEW_HEAD = ["| Attribute             | Value                                         |",
                 "|-----------------------|-----------------------------------------------|"]
OVERVIEW = [("Total Records", "records"), ("Date Range", "dates"), ("Cities Covered", "cities"),
            ("Product Categories", "categories"), ("Unique Products", "products"), ("Total Revenue", "revenue"),
            ("Average Order Value", "mean")]
FINDINGS = [("Total Revenue", "millions"), ("Average Order Value", "whole_mean"), ("Total Orders Processed", "records"),
            ("Top Category", "top_category"), ("Top City", "top_city"), ("Top Product", "top_product"),
            ("Best Sales Month", "month")]


def _overview_lines(overview: DataFrame, named: DataFrame) -> DataFrame:
    """Overview table and key findings from the one-row sections ``insights_overview`` and ``named_category_share``."""
    amount = lambda key, text, *more: F.concat(F.col(key), F.lit(" ("), F.col(text), *more, F.lit(")"))
    value = {
        "records": F.format_number("Total_Records", 0),
        "dates": F.concat_ws(" → ", F.col("Date_Min").cast("string"), F.col("Date_Max").cast("string")),
        "cities": F.col("Cities").cast("string"), "categories": F.col("Categories").cast("string"),
        "products": F.col("Products").cast("string"), "revenue": F.col("Total_Revenue_Text"),
        "mean": F.col("Avg_Order_Value_Text"), "millions": F.col("Total_Revenue_Millions"),
        "whole_mean": F.col("Avg_Order_Value_Whole"), "month": F.col("Best_Month"),
        "top_category": amount("Top_Category", "Top_Category_Revenue_Text", F.lit(" — "),
                               F.format_string("%.1f", F.col("Top_Category_Share_Pct")), F.lit("% of revenue")),
        "top_city": amount("Top_City", "Top_City_Revenue_Text"), "top_product": amount("Top_Product", "Top_Product_Revenue_Text"),
    }
    given = lambda k: F.coalesce(value[k], F.lit(""))
    rows = [F.lit(x) for x in OVERVIEW_HEAD]
    rows += [F.concat(F.lit(f"| {label:<21} | "), fmt.pad_right(given(k), 45), F.lit(" |")) for label, k in OVERVIEW]
    rows += [F.concat(F.lit(f"- **{label}:** "), given(k)) for label, k in FINDINGS]
    share = named.select(F.struct(F.lit(0).alias("Table"), F.lit(2).alias("Part"), F.lit(0).alias("Row"), F.concat(
        F.lit("- **"), F.col("Category"), F.lit(":** "), F.coalesce("Share_Label", F.lit("")), F.lit(" of revenue")).alias("Line")).alias("l"))
    lines = overview.select(F.posexplode(F.array(*rows)).alias("Row", "Line")).select(
        F.struct(F.lit(0).alias("Table"), F.lit(1).alias("Part"), F.col("Row").alias("Row"), "Line").alias("l"))
    return lines.unionByName(share).select("l.Table", "l.Part", "l.Row", F.lit(None).cast("double").alias("_desc"),
                                           F.lit(None).cast("string").alias("_key"), "l.Line")


def report_lines(secs: dict[str, DataFrame], generated_at: datetime) -> DataFrame:
    """Lines of the report's stamp, overview, findings and three revenue tables, with their sort columns (``ORDER``)."""
    spark: SparkSession = secs["insights_category_breakdown"].sparkSession
    stamp = spark.range(1).select(F.lit(0).alias("Table"), F.lit(0).alias("Part"), F.lit(0).alias("Row"),
                                  F.lit(None).cast("double").alias("_desc"), F.lit(None).cast("string").alias("_key"),
                                  F.concat(F.lit("> **Generated:** "),
                                           fmt.report_timestamp(F.lit(generated_at))).alias("Line"))
    cat = secs["insights_category_breakdown"]
    city = secs["insights_city_breakdown"]
    prod = secs["insights_product_breakdown"]
    share = F.format_string("%.1f", F.col("Share_Pct"))
    parts = [
        stamp,
        _overview_lines(secs["insights_overview"], secs["named_category_share"]),
        _table(cat, 1, "Category",
               ["| Category   | Revenue (Rs.)      | Share (%) |", "|------------|--------------------|-----------|"],
               [fmt.pad_right(F.col("Category"), 10), fmt.pad_left(F.col("Revenue_Text"), 18), fmt.pad_left(share, 8)]),
        _table(city, 2, "City", ["| City        | Revenue (Rs.)      |", "|-------------|--------------------|"],
               [fmt.pad_right(F.col("City"), 11), fmt.pad_left(F.col("Revenue_Text"), 18)]),
        _table(prod, 3, "Product", ["| Product     | Revenue (Rs.)      |", "|-------------|--------------------|"],
               [fmt.pad_right(F.col("Product"), 11), fmt.pad_left(F.col("Revenue_Text"), 18)]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered_lines(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER]).select("Line")


def write_report(secs: dict[str, DataFrame], path: str, generated_at: datetime, single_file: bool = False) -> None:
    """The computed report as Markdown text at ``path`` (sorted part files, or one file)."""
    lines = ordered_lines(report_lines(secs, generated_at))
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)
