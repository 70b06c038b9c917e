"""CSV scan and sink for the sales table (A1).

The header names the columns: the twelve business columns are found by name, in any
order and among others, and a missing one is an error.  Fields are quoted by ``"``, and
``""`` inside a quoted field is one quote.  Every field is read as text (typing is
``operators.clean``'s job); a row with too few or too many fields is kept, with its text in
the column ``MALFORMED``.  Files whose headers differ from the first file's stop the read
instead of shifting values.

Spark splits the files across tasks, so the scan scales with the file count and size.
``multi_line=True`` reads quoted line breaks as part of their field; such a file cannot be
split, so each is then one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.schema import COLUMNS, MALFORMED

DIALECT = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_options(multi_line: bool = False) -> dict[str, str]:
    return DIALECT | {"header": "true", "mode": "PERMISSIVE", "multiLine": str(multi_line).lower(),
                      "columnPruning": "false"}  # a row that lacks fields shows only if all are parsed


def header_of(spark: SparkSession, path: str, multi_line: bool = False) -> list[str]:
    """The column names of the first file; fails if a business column is missing."""
    names = spark.read.options(**read_options(multi_line)).csv(path).columns
    missing = [c for c in COLUMNS if c not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(names)}")
    return names


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in [*names, MALFORMED]])


#: Where a row stands in its source: file, first byte of the split that it was read with, number in the scan.
SOURCE_PLACE = ["src_file", "src_block", "src_row"]


def read_sales_csv(spark: SparkSession, path: str, multi_line: bool = False, places: bool = False) -> DataFrame:
    """Raw rows: the twelve business columns as strings, ``MALFORMED``, and with ``places`` also ``SOURCE_PLACE``."""
    names = header_of(spark, path, multi_line)
    rows = (spark.read.schema(text_schema(names)).options(**read_options(multi_line))
            .option("enforceSchema", False).option("columnNameOfCorruptRecord", MALFORMED).csv(path))
    place = [F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("src_block"),
             F.monotonically_increasing_id().alias("src_row")]
    return rows.select(*COLUMNS, MALFORMED, *(place if places else []))


def write_sales_csv(df: DataFrame, path: str) -> None:
    """Write the twelve columns as CSV with a header (dates ``yyyy-MM-dd``), replacing ``path``."""
    (df.select(*COLUMNS).write.mode("overwrite").options(**DIALECT)
       .option("header", True).option("dateFormat", "yyyy-MM-dd")
       .csv(path))
