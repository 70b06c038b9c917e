"""SQL functions for users who write their own SQL over the sales table.

``register_functions(spark)`` creates SQL functions (inlined SQL expressions, no Python)
for the exact rounding that the reports use:

    register_functions(spark)
    spark.table("sales_analytics.sales_data").createOrReplaceTempView("sales_data")
    spark.sql("SELECT City, exact_round(SUM(Total_Sales), COUNT(Total_Sales), 2) FROM sales_data GROUP BY City")
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = [
    # n · 10^4 as an exact integer: both sides of a ratio get the same factor.
    """CREATE OR REPLACE TEMPORARY FUNCTION bz_int(x DECIMAL(34,4)) RETURNS DECIMAL(38,0)
       RETURN CAST(x * 10000 AS DECIMAL(38,0))""",
    # Exact floor(a / b) for a >= 0, b > 0: a - a % b is a multiple of b.
    """CREATE OR REPLACE TEMPORARY FUNCTION bz_floor_div(a DECIMAL(38,0), b DECIMAL(38,0)) RETURNS DECIMAL(38,0)
       RETURN CAST((a - a % b) / b AS DECIMAL(38,0))""",
    # round(t / u), half away from zero, on integers.
    """CREATE OR REPLACE TEMPORARY FUNCTION bz_round_int(t DECIMAL(38,0), u DECIMAL(38,0)) RETURNS DECIMAL(38,0)
       RETURN bz_floor_div(CAST(2 * abs(t) + abs(u) AS DECIMAL(38,0)), CAST(nullif(2 * abs(u), 0) AS DECIMAL(38,0)))
              * CASE WHEN (t < 0) <> (u < 0) THEN -1 ELSE 1 END""",
    # ROUND(n / d, k) from the exact quotient, as DOUBLE.
    """CREATE OR REPLACE TEMPORARY FUNCTION exact_round(n DECIMAL(34,4), d DECIMAL(34,4), k INT) RETURNS DOUBLE
       RETURN CAST(bz_round_int(CAST(bz_int(n) * CAST(power(10, k) AS DECIMAL(20,0)) AS DECIMAL(38,0)), bz_int(d))
                   / CAST(power(10, k) AS DECIMAL(20,0)) AS DOUBLE)""",
]


def register_functions(spark: SparkSession) -> None:
    for ddl in FUNCTIONS:
        spark.sql(ddl)
