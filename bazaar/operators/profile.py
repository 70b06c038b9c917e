"""Data profiling of the EDA half.

* ``dataset_summary`` — shape, date range, the number of distinct values of the three
  dimensions and their sorted lists, from one grouping-sets aggregate (the lists are joined
  from its one row per key); ``dimension_values`` — the values as rows, in order.
* ``missing_values`` — NULL count and percent per column in one pass, unpacked
  into one row per column; columns without NULLs are left out.
* ``describe_numeric`` — count, mean, sample std, min, exact quartiles, max for
  the numeric columns; quartiles come from ``quantiles.percentiles_of_counts``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.money import round_ratio
from bazaar.operators.quantiles import counted, percentiles_of_counts, ranged
from bazaar.operators.summaries import grouping_code, key_list
from bazaar.schema import DIMENSIONS, NUMERIC_PROFILE_COLUMNS
from bazaar.session import shared_path

COUNT_NAMES = {"City": "Cities", "Category": "Categories", "Product": "Products"}


def _names(dim: str) -> list[str]:
    return [COUNT_NAMES.get(dim, f"{dim}_Count"), f"{dim}_List"]


def present_summary(groups: DataFrame, dims: list[str], columns: list[str], of: list[str] = DIMENSIONS) -> DataFrame:
    """The summary from a grouping-sets table of ``dims`` with ``_rows _dmin _dmax _gid`` (one row per key and set)."""
    whole = F.col("_gid") == grouping_code(dims, None)
    row = groups.agg(
        F.coalesce(F.max(F.when(whole, F.col("_rows"))), F.lit(0).cast("bigint")).alias("Rows"),
        F.max(F.when(whole, F.col("_dmin"))).alias("Date_Min"), F.max(F.when(whole, F.col("_dmax"))).alias("Date_Max"),
        *[c.alias(n) for d in of for n, c in zip(_names(d), [
            F.count_if((F.col("_gid") == grouping_code(dims, d)) & F.col(d).isNotNull()), key_list(dims, d)])])
    return row.select("Rows", F.lit(len(columns)).alias("Columns"), F.lit(", ".join(columns)).alias("Column_List"),
                      "Date_Min", "Date_Max", *[n for d in of for n in _names(d)])


def dataset_summary(df: DataFrame, dims: list[str] = DIMENSIONS) -> DataFrame:
    """Rows, columns, column names, date range, and the number and sorted list of each dimension's values."""
    groups = df.select(*dims, "Order_Date").groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("Order_Date").alias("_dmin"), F.max("Order_Date").alias("_dmax"),
        F.grouping_id().alias("_gid"))
    return present_summary(groups, dims, df.columns, dims)


def dimension_values(df: DataFrame, dims: list[str] = DIMENSIONS) -> DataFrame:
    """The distinct values of each dimension in order, as rows ``Dimension, Position`` (from 1) ``, Value``."""
    cells = F.array(*[F.struct(F.lit(d).alias("Dimension"), F.col(d).cast("string").alias("Value")) for d in dims])
    return present_values(df.select(F.inline(cells)).where(F.col("Value").isNotNull()).distinct())


def present_values(values: DataFrame) -> DataFrame:
    """Distinct ``(Dimension, Value)`` rows, numbered.

    They are sorted by ranges and written with the number of the range; a value's position is its place inside its
    range, which one window partition sorts, plus the rows of the ranges before it (one row per range and dimension).
    """
    spark = values.sparkSession
    path = shared_path(spark, "dimension_values", uuid.uuid4().hex)
    placed = (values.select("Dimension", "Value").repartitionByRange("Dimension", "Value")
              .withColumn("_b", F.spark_partition_id()))
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    before = Window.partitionBy("Dimension").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("Dimension", "_b").agg(F.count(F.lit(1)).alias("_n"))
                  .select("Dimension", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    place = F.row_number().over(Window.partitionBy("Dimension", "_b").orderBy("Value"))
    return (rows.withColumn("_place", place).join(F.broadcast(starts), ["Dimension", "_b"])
                .select("Dimension", (F.col("_start") + F.col("_place")).alias("Position"), "Value"))


def missing_aggs(columns: list[str]) -> list[Column]:
    """Aggregates behind ``missing_values``: NULL count per column (plus ``Rows`` from ``summary_aggs``)."""
    return [F.count_if(F.col(c).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)]


def present_missing(row: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("Position"), F.lit(c).alias("Column"),
                               F.col(f"_m{i}").alias("Missing_Count")) for i, c in enumerate(columns)])
    long = row.select(F.col("Rows").alias("_rows"), F.inline(cells))
    return (long.where(F.col("Missing_Count") > 0)
                .select("Position", "Column", "Missing_Count",
                        round_ratio(F.col("Missing_Count"), F.col("_rows"), scale=2,
                                    factor=100, half_even=True).alias("Missing_Pct"))
                .orderBy("Position"))


def missing_values(df: DataFrame) -> DataFrame:
    """NULL count and percent of rows (two decimals) per column that has NULLs, in column order."""
    return present_missing(df.agg(F.count(F.lit(1)).alias("Rows"), *missing_aggs(df.columns)), df.columns)


def long_type(df: DataFrame, columns: list[str]) -> str:
    """One type that holds the profiled columns exactly: two places unless a DECIMAL has more."""
    scales = [t.scale for t in (df.schema[c].dataType for c in columns) if isinstance(t, T.DecimalType)]
    return "decimal(28,6)" if max(scales, default=0) > 2 else "decimal(24,2)"


def describe_numeric(df: DataFrame, columns: list[str] = NUMERIC_PROFILE_COLUMNS, exact: bool = True,
                     accuracy: int = 10_000, ranges: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max, one row per numeric column.

    The fact is read once: the ``(column, value)`` long form is reduced to a (value, count) table in
    ranges.  Counts, exact sums, minima and maxima are observed while that table is written; one read of it
    gives the spread around the exact means and the counts per range, and the quartiles read only the
    ranges that hold them.  An all-NULL column still gets its row.
    ``exact=False`` takes the quartiles from a ``percentile_approx`` sketch per
    column instead (rank error about ``1/accuracy``; one pass, no written table).
    ``ranges`` goes to ``quantiles.ranged``.
    """
    long = long_form(df, columns)
    if exact:
        _check_exact_types(df, columns)
        return describe_counted(counted(long, "_k", "_v"), columns, ranges)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c)
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).cast("decimal(38,2)").alias(f"s{i}"),
                 F.stddev_samp(x.cast("double")).alias(f"d{i}"),
                 F.min(x).cast("double").alias(f"lo{i}"), F.max(x).cast("double").alias(f"hi{i}")]
    moments = df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_k"), F.col(f"n{i}").alias("_n"), F.col(f"s{i}").alias("_s"),
                 F.col(f"d{i}").alias("_sd"), F.col(f"lo{i}").alias("_lo"), F.col(f"hi{i}").alias("_hi"))
        for i in range(len(columns))])))
    sketch = F.percentile_approx("_v", [0.25, 0.5, 0.75], accuracy)
    quart = long.groupBy("_k").agg(sketch.alias("_q")).select(
        "_k", *[F.col("_q")[i].alias(f"p{i}") for i in range(3)])
    # The list of columns (a literal, one row per profiled column) keeps a row for an all-NULL column.
    names = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_k"), F.lit(c).alias("Column")) for i, c in enumerate(columns)])))
    return _present_describe(names.join(F.broadcast(moments), "_k", "left").join(F.broadcast(quart), "_k", "left"))


def _check_exact_types(df: DataFrame, columns: list[str]) -> None:
    """The exact path holds values as DECIMAL(28,6): integral columns and DECIMALs with at most 6 places."""
    for c in columns:
        t = df.schema[c].dataType
        fits = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (
            isinstance(t, T.DecimalType) and t.scale <= 6 and t.precision - t.scale <= 22)
        if not fits:
            raise ValueError(f"describe_numeric(exact=True) needs integral or DECIMAL columns of at most 22.6 digits; "
                             f"{c} is {t.simpleString()} — use exact=False for it")


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(_k, _v)``: one row per (column index, value) of the profiled columns."""
    kind = long_type(df, columns)
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("_k"), F.col(c).cast(kind).alias("_v")) for i, c in enumerate(columns)])))


def describe_counted(counts: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """The exact describe table from ``quantiles.counted`` values of ``long_form`` (reads no fact rows)."""
    totals = Observation()
    kind = counts.schema["v"].dataType
    metrics = []
    for i in range(len(columns)):
        mine = F.col("_k") == i
        metrics += [F.coalesce(F.sum(F.when(mine, F.col("c"))), F.lit(0)).alias(f"n{i}"),
                    F.sum(F.when(mine, F.col("c") * F.col("v"))).alias(f"s{i}"),
                    F.min(F.when(mine, F.col("_vd"))).alias(f"lo{i}"), F.max(F.when(mine, F.col("_vd"))).alias(f"hi{i}")]
    vc = ranged(counts, "_k", ranges, (totals, metrics))
    got = totals.get
    total = T.DecimalType(38, kind.scale)
    cells, mean = [], F.lit(None).cast("double")
    for i, c in enumerate(columns):
        n, s = got[f"n{i}"], F.lit(got[f"s{i}"]).cast(total)
        cells.append(F.struct(F.lit(i).alias("_k"), F.lit(c).alias("Column"), F.lit(n).cast("bigint").alias("_n"), s.alias("_s"),
                              F.lit(got[f"lo{i}"]).cast("double").alias("_lo"), F.lit(got[f"hi{i}"]).cast("double").alias("_hi")))
        mean = F.when(F.col("_k") == i, (s / F.nullif(F.lit(n), F.lit(0))).cast("double")).otherwise(mean)
    # Sample variance, stable: Σ c·(v − mean)² around the exact mean.
    spread = {"_ss": F.col("c") * F.pow(F.col("_vd") - mean, 2)}
    quart = percentiles_of_counts(vc, "_k", [0.25, 0.5, 0.75], spread)
    names = vc.sparkSession.range(1).select(F.inline(F.array(*cells)))  # a row per profiled column
    return _present_describe(names.join(F.broadcast(quart), "_k", "left").withColumn(
        "_sd", F.when(F.col("_n") > 1, F.sqrt(F.col("_ss") / (F.col("_n") - 1)))))


def _present_describe(rows: DataFrame) -> DataFrame:
    as_double = lambda e: F.round(F.col(e).cast("double"), 6)
    return (rows.select("Column", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("Count"),
                        round_ratio(F.col("_s"), F.col("_n"), scale=6, half_even=True).alias("Mean"),
                        F.round(F.col("_sd"), 6).alias("Std"), F.col("_lo").alias("Min"),
                        as_double("p0").alias("P25"), as_double("p1").alias("P50"), as_double("p2").alias("P75"),
                        F.col("_hi").alias("Max"))
                .orderBy("_k"))
