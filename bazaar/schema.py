"""Schema of the sales fact table and the fixed values the reports depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# Business column order of the fact table (the load job's insert order).
COLUMNS = [
    "Order_ID", "Order_Date", "Customer_ID", "Customer_Name", "Age", "Gender",
    "City", "Product", "Category", "Quantity", "Unit_Price", "Total_Sales",
]

MONEY = T.DecimalType(14, 2)        # Total_Sales
PRICE = T.DecimalType(12, 2)        # Unit_Price
# Of a file that is reported on directly, whose numbers no table's declaration bounds.
REPORT_NUMBER = T.DecimalType(24, 6)  # Age and Quantity
REPORT_MONEY = T.DecimalType(18, 2)   # Unit_Price and Total_Sales

# Column of a CSV row that could not be split into its columns: its text.
MALFORMED = "_malformed"

SALES_SCHEMA = T.StructType([
    T.StructField("Order_ID", T.StringType(), False),
    T.StructField("Order_Date", T.DateType(), True),
    T.StructField("Customer_ID", T.StringType(), True),
    T.StructField("Customer_Name", T.StringType(), True),
    T.StructField("Age", T.IntegerType(), True),
    T.StructField("Gender", T.StringType(), True),
    T.StructField("City", T.StringType(), True),
    T.StructField("Product", T.StringType(), True),
    T.StructField("Category", T.StringType(), True),
    T.StructField("Quantity", T.IntegerType(), True),
    T.StructField("Unit_Price", PRICE, True),
    T.StructField("Total_Sales", MONEY, True),
])

# The CSV is read with every field as text; coercion happens in Spark.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in COLUMNS])

# Declared maximum lengths of the text columns (table DDL).
MAX_LENGTH = {
    "Order_ID": 20, "Customer_ID": 20, "Customer_Name": 50, "Gender": 10,
    "City": 50, "Product": 100, "Category": 50,
}

NUMERIC_PROFILE_COLUMNS = ["Age", "Quantity", "Unit_Price", "Total_Sales"]
DIMENSIONS = ["City", "Category", "Product"]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# SQL age bands (CASE chain; everything from 60 up, and anything not matched, is "60+").
SQL_AGE_BANDS = ["Under 20", "20 – 29", "30 – 39", "40 – 49", "50 – 59", "60+"]

# Python age bands: left-closed bins [0,20) [20,30) [30,40) [40,50) [50,60) [60,70).
EDA_AGE_EDGES = [0, 20, 30, 40, 50, 60, 70]
EDA_AGE_LABELS = ["<20", "20-29", "30-39", "40-49", "50-59", "60+"]

# Age histogram: 20 equal-width bins; bars grouped by the bin's left edge.
HISTOGRAM_BINS = 20
HISTOGRAM_BANDS = [          # (left edge below, label); last row is the rest
    (25, "< 25"),
    (40, "25 – 39"),
    (55, "40 – 54"),
    (None, "55 +"),
]

# Kernel density evaluated at this many equally spaced points from min to max age.
DENSITY_POINTS = 300

CURRENCY_PREFIX = "Rs."

# Category whose revenue share the report calls out by name.
NAMED_CATEGORY = "Electronics"

# Text values read as missing in any CSV column (the pandas reader's default list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Date formats tried, in order, when parsing Order_Date text.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd"]

# Reasons a raw row is sent to quarantine instead of the table.
QUARANTINE_REASONS = ["malformed", "order_id_null", "order_id_length", "fractional_age", "fractional_quantity",
                      "integer_overflow", "money_overflow", "text_length"]
