"""Registered queries for the ingest path.

Each starts from a CSV copy of the sales table (written once per input into
the shared folder) with other columns in another order and with dirty values in known rows
(``dirty``), so the real reader, coercion, load job, reconciliation
and surrogate key run over the whole data, and returns a small aggregate of
what came through — which an independent SQL oracle can recompute from the
source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.operators.clean import best_format, coerce, report_rows, valid_rows, with_one_date_format
from bazaar.plans import load_job
from bazaar.schema import COLUMNS, QUARANTINE_REASONS
from bazaar.session import shared_path, shuffles_removed
from bazaar.sources.csv import DIALECT, read_sales_csv
from bazaar.sources.fallback import load_raw
from bazaar.sources.jdbc import JdbcSource
from bazaar.sources.tables import fingerprint, sales_once, sales_table
from bazaar.sources.versions import written_once

CENTS = T.DecimalType(38, 0)
TEXT = ["Order_ID", "Customer_ID", "Customer_Name", "Gender", "City", "Product", "Category"]

# A JDBC URL no driver accepts: the fallback query exercises the database-first
# path without any database being started.
UNREACHABLE = JdbcSource(url="jdbc:unreachable://localhost/sales_analytics_db")


#: Columns of the CSV copy: not in the table's order, and one more.
CSV_ORDER = ["Remark", "Category", "City", *[c for c in reversed(COLUMNS) if c not in ("Category", "City")]]


def dirty(fact: DataFrame) -> DataFrame:
    """The sales rows as text, with dirty values in the rows of some order numbers (the oracle has the same rules)."""
    fact = fact.withColumn("_n", F.split_part("Order_ID", F.lit("-"), F.lit(1)).cast("bigint"))
    n = F.col("_n")
    text = {c: F.col(c).cast("string") for c in COLUMNS}
    rules = {
        "Age": [(107, F.lit("99999999999")), (101, F.concat(text["Age"], F.lit(".5")))],
        "Quantity": [(103, F.concat(text["Quantity"], F.lit(".25")))],
        "Total_Sales": [(109, F.lit("1000000000000.00"))],
        "City": [(113, F.lit("x" * 51)), (151, F.concat(F.lit(" "), text["City"]))],
        "Order_ID": [(127, F.lit("")), (131, F.concat(text["Order_ID"], F.lit("-" + "0" * 20)))],
        "Gender": [(137, F.lit("N/A"))],
        "Order_Date": [(139, F.lit("2025-02-30"))],
        "Product": [(149, F.lit('Monitor 24", black'))],
    }
    for c, cases in rules.items():
        for divisor, value in reversed(cases):
            text[c] = F.when(n % divisor == 0, value).otherwise(text[c])
    return fact.select(*[text[c].alias(c) for c in COLUMNS], F.lit('a "remark", unused').alias("Remark")).select(*CSV_ORDER)


def sales_csv(spark: SparkSession, sf_dir: str) -> str:
    """The dirty copy, compressed; such a file is read by one task, so each is short."""
    def write(folder: str) -> None:
        rows = dirty(sales_once(spark, sf_dir)).write.options(**DIALECT).option("header", True)
        rows.option("compression", "gzip").option("maxRecordsPerFile", 500_000).csv(folder)

    return written_once(spark, shared_path(spark, "sales_csv_dirty", fingerprint(sf_dir, spark)), write)


#: Rows of a file of the ordered copy, about: each is sorted in memory by one task, at any size of the table.
FILE_ROWS = 500_000
#: The copy is sorted in that many parts at most, one after another, so that only one part's shuffle files exist at a time.
SORT_PARTS, PART_ROWS = 3, 2_000_000


def cut_rows(fact: DataFrame, parts: int, total: int, sample: int = 10_000) -> list[Column]:
    """Rows that cut the sorted table into about equal parts, as structs, found in a sample of bounded size.  Any rows will do:
    where they lie decides how long the parts are, not what they hold."""
    some = fact.sample(min(1.0, sample / total), seed=0).repartition(1).sortWithinPartitions(*COLUMNS)
    texts = some.select(*[F.col(c).cast("string") for c in COLUMNS]).collect()  # as text, a value that Python lacks is kept
    cuts = dict.fromkeys(tuple(texts[len(texts) * i // parts]) for i in range(1, parts) if texts)
    kinds = [fact.schema[c].dataType for c in COLUMNS]
    return [F.struct(*[F.lit(v).cast(kind).alias(c) for c, v, kind in zip(COLUMNS, cut, kinds)]) for cut in cuts]


def write_ordered(fact: DataFrame, folder: str) -> None:
    """Compressed CSV files whose paths follow the order of all columns: a folder per part, a file or more per range in it."""
    total = fact.count()
    parts = min(SORT_PARTS, 1 + total // PART_ROWS)
    cuts = cut_rows(fact, parts, total) if parts > 1 else []
    whole_row = F.struct(*COLUMNS)  # compared as the sort compares the columns: nulls first
    # Files are named part-<range, five digits>-...-c<file of the range, three digits>: longer numbers would not sort after these.
    ranges = min(max(7, -(-total // (FILE_ROWS * (len(cuts) + 1)))), 100_000)
    file_rows = max(FILE_ROWS, -(-total // 999))
    for i, (first, end) in enumerate(zip([None, *cuts], [*cuts, None])):
        rows = fact if first is None else fact.where(whole_row >= first)
        rows = rows if end is None else rows.where(whole_row < end)
        rows = rows.repartitionByRange(ranges, *COLUMNS).sortWithinPartitions(*COLUMNS).write.options(**DIALECT).option("header", True)
        rows.option("compression", "gzip").option("maxRecordsPerFile", file_rows).csv(f"{folder}/{i:03d}")


def ordered_csv(spark: SparkSession, sf_dir: str) -> str:
    """The sales rows as CSV files that hold them in order of all their columns, file by file."""
    def write(folder: str) -> None:
        with shuffles_removed(spark):
            write_ordered(sales_table(spark, sf_dir), folder)

    return written_once(spark, shared_path(spark, "sales_csv_ordered", fingerprint(sf_dir, spark)), write) + "/*"


def column_profile(df: DataFrame, cents: bool = False) -> DataFrame:
    """One row of order-independent checksums covering every column; sums of amounts in ``cents`` are DECIMAL(38,0), exact at any size."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("Rows")]
    for c in TEXT:
        aggs += [F.count(c).alias(f"{c}_Count"), F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(f"{c}_Chars")]
    aggs += [F.count("Order_Date").alias("Order_Date_Count"), F.min("Order_Date").alias("Order_Date_Min"),
             F.max("Order_Date").alias("Order_Date_Max"),
             F.coalesce(F.sum(F.dayofmonth("Order_Date")), F.lit(0)).alias("Order_Date_Day_Sum")]
    for c in ["Age", "Quantity"]:
        aggs += [F.count(c).alias(f"{c}_Count"), F.sum(c).cast("double").alias(f"{c}_Sum")]
    for c in ["Unit_Price", "Total_Sales"]:
        total = (F.sum(c) * 100).cast(CENTS).alias(f"{c}_Cents") if cents else F.sum(c).cast("double").alias(f"{c}_Sum")
        aggs += [F.count(c).alias(f"{c}_Count"), total]
    return df.agg(*aggs)


def in_bigint(profile: DataFrame) -> DataFrame:
    """The one row of a ``column_profile`` in cents, computed now: sums are BIGINT as the SQL declares them, and stay
    DECIMAL(38,0) where they do not fit (the SQL fails there)."""
    row = profile.first()
    small = lambda f: f.dataType == CENTS and abs(row[f.name] or 0) < 2 ** 63
    fields = [T.StructField(f.name, T.LongType() if small(f) else f.dataType) for f in profile.schema.fields]
    values = [int(v) if f.dataType == T.LongType() and v is not None else v for f, v in zip(fields, row)]
    return profile.sparkSession.createDataFrame([tuple(values)], T.StructType(fields))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A4 + A5: write the dirty table as CSV, read it back by header, coerce, profile the valid rows."""
    raw = read_sales_csv(spark, sales_csv(spark, sf_dir))
    return column_profile(valid_rows(coerce(raw)))


def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Database first (unreachable here), then the CSV; profile of what the reports read: every row."""
    raw, used = load_raw(spark, UNREACHABLE, sales_csv(spark, sf_dir))
    return in_bigint(column_profile(report_rows(raw), cents=True)).select(F.lit(used).alias("Source"), "*")


def _loaded(spark: SparkSession, sf_dir: str, query: str, csv=sales_csv, runs: int = 1) -> tuple[str, DataFrame]:
    """The database that was loaded, and the reconciliation of the last run."""
    # One database per query, so queries running side by side never rewrite each other's table.
    db = f"sales_{fingerprint(sf_dir, spark)}_{query}"
    raw = read_sales_csv(spark, csv(spark, sf_dir), places=True)
    for _ in range(runs):
        reconciled = load_job.run(spark, raw, db)
    return db, reconciled


def full_refresh_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load twice (a rerun must replace, not append), then summarise the table."""
    db, _ = _loaded(spark, sf_dir, "full_refresh", runs=2)
    t = load_job.sales_data(spark, db)
    return t.agg(F.count(F.lit(1)).alias("Rows"), F.count("Total_Sales").alias("Sales"),
                 F.sum("Total_Sales").cast("double").alias("Total_Sales_Sum"))


def load_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows, counted while they were loaded, = loaded rows + quarantined rows."""
    return _loaded(spark, sf_dir, "reconciliation")[1]


def source_order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every loaded row, which follows the order of files and of lines in them."""
    db, _ = _loaded(spark, sf_dir, "source_order", csv=ordered_csv)
    return load_job.sales_rows(spark, db).select("id", "Order_ID", "Order_Date", "Product", F.col("Total_Sales").cast("double").alias("Total_Sales"))


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per outcome — ``valid`` and every quarantine reason, zero when absent."""
    db, _ = _loaded(spark, sf_dir, "quarantine")
    t = spark.table(f"`{db}`.`sales_load`")
    outcomes = [load_job.VALID] + QUARANTINE_REASONS
    row = t.agg(F.count_if(F.col("Status") == load_job.VALID).alias("o0"),
                *[F.count_if(F.col("Reason") == r).alias(f"o{i + 1}") for i, r in enumerate(QUARANTINE_REASONS)])
    cells = F.array(*[F.struct(F.lit(o).alias("Outcome"), F.col(f"o{i}").alias("Rows"))
                      for i, o in enumerate(outcomes)])
    return row.select(F.inline(cells))


def surrogate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 1..n key over the loaded table."""
    db, _ = _loaded(spark, sf_dir, "surrogate_key")
    keyed = load_job.with_surrogate_key(load_job.sales_data(spark, db))
    return keyed.agg(F.count(F.lit(1)).alias("Rows"), F.count_distinct("id").alias("Distinct_Ids"),
                     F.min("id").alias("Min_Id"), F.max("id").alias("Max_Id"))


#: Candidate formats of a file whose dates are written day first; the second reads many of them, wrongly.
CANDIDATES = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"]


def day_first_csv(spark: SparkSession, sf_dir: str) -> str:
    """The sales rows as CSV with dates as dd/MM/yyyy, and with text that is no date in the rows of some order numbers."""
    def write(folder: str) -> None:
        n = F.split_part("Order_ID", F.lit("-"), F.lit(1)).cast("bigint")
        text = F.when(n % 139 == 0, F.lit("31/02/2025")).when(n % 149 == 0, F.lit("soon")).otherwise(F.date_format("Order_Date", "dd/MM/yyyy"))
        sales_table(spark, sf_dir).withColumn("Order_Date", text).write.options(**DIALECT).option("header", True).csv(folder)

    return written_once(spark, shared_path(spark, "sales_csv_day_first", fingerprint(sf_dir, spark)), write)


def date_format_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of a file's dates, chosen by how many of them it reads, and the orders per date so read."""
    raw = read_sales_csv(spark, day_first_csv(spark, sf_dir))
    dated = report_rows(with_one_date_format(raw, CANDIDATES)).groupBy("Order_Date").agg(F.count(F.lit(1)).alias("Orders"))
    return dated.select(best_format(raw, CANDIDATES).alias("Date_Format"), "Order_Date", "Orders")


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "source_fallback": source_fallback,
    "full_refresh_load": full_refresh_load,
    "load_reconciliation": load_reconciliation,
    "quarantine_counts": quarantine_counts,
    "surrogate_key": surrogate_key,
    "source_order_ids": source_order_ids,
    "date_format_choice": date_format_choice,
}
