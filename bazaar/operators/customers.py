"""Exact numbers of distinct customers that can be merged, from the pass that adds up revenue.

``COUNT(DISTINCT)`` per set of keys makes Spark expand rows once more per distinct aggregate, and its result cannot be added to
another day's.  Here a customer gets a dense number (``profile.dimension_values``: place in the sorted list, found by ranges),
and one GROUPING SETS aggregate over (key, bucket of 32,768 numbers) builds a bitmap of the numbers in each bucket next to the sums.
Counting bits gives exact numbers; tables of such bitmaps with the same numbering merge by OR (``merged``).

A bitmap has 4 KB whatever it holds, so this is for keys of few values: size is keys x customers / 8 bytes at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.operators.profile import dimension_values
from bazaar.operators.summaries import MONTH, grouping_code, key_column

CUSTOMER = "Customer_ID"
DIMS = ["City", "Category", "Gender", MONTH]


def numbering(df: DataFrame, customer: str = CUSTOMER) -> DataFrame:
    """``(_customer, _number)``: the distinct customers numbered from 1, written."""
    return dimension_values(df, [customer]).select(F.col("Value").alias("_customer"), F.col("Position").alias("_number"))


def bitmaps(df: DataFrame, numbers: DataFrame, dims: list[str] = DIMS, customer: str = CUSTOMER) -> DataFrame:
    """``(Dimension, Key, _bucket, _bits, _rev, _rows)`` of each dimension and of all rows (Dimension ``All``); NULL keys are keys.

    Rows without customer count in ``_rev`` and ``_rows`` of bucket NULL.
    """
    number = F.col("_number")
    rows = (df.select(*[key_column(d).cast("string").alias(d) for d in dims], F.col("Total_Sales"), F.col(customer).cast("string").alias("_of"))
              .join(numbers, F.col("_of") == F.col("_customer"), "left")
              .withColumn("_bucket", F.bitmap_bucket_number(number)).withColumn("_bit", F.bitmap_bit_position(number)))
    keys = [*dims, "_bucket"]
    sets = [[d, "_bucket"] for d in dims] + [["_bucket"]]
    out = rows.groupingSets(sets, *keys).agg(
        F.bitmap_construct_agg("_bit").alias("_bits"), F.sum("Total_Sales").alias("_rev"), F.count(F.lit(1)).alias("_rows"),
        F.grouping_id().alias("_gid"))
    name, key = F.lit("All"), F.lit(None).cast("string")
    for d in dims:
        mine = F.col("_gid") == grouping_code(keys, d) - 1  # its set holds the bucket too
        name, key = F.when(mine, F.lit(d)).otherwise(name), F.when(mine, F.col(d)).otherwise(key)
    return out.select(name.alias("Dimension"), key.alias("Key"), "_bucket", "_bits", "_rev", "_rows")


def merged(parts: list[DataFrame]) -> DataFrame:
    """One table of ``bitmaps`` from several with the same numbering, e.g. of different days."""
    return reduce(DataFrame.unionByName, parts).groupBy("Dimension", "Key", "_bucket").agg(
        F.bitmap_or_agg("_bits").alias("_bits"), F.sum("_rev").alias("_rev"), F.sum("_rows").alias("_rows"))


def present_customers(table: DataFrame) -> DataFrame:
    bits: Column = F.when(F.col("_bucket").isNotNull(), F.bitmap_count("_bits"))
    return table.groupBy("Dimension", "Key").agg(
        F.sum("_rev").cast("double").alias("Total_Revenue_INR"), F.sum("_rows").alias("Total_Orders"),
        F.coalesce(F.sum(bits), F.lit(0)).alias("Unique_Customers"))


def customers_rollup(df: DataFrame) -> DataFrame:
    """C10 / Q5 for every low-cardinality key at once: revenue, orders and distinct customers per city, category, gender and month, and of all."""
    return present_customers(bitmaps(df, numbering(df)))
