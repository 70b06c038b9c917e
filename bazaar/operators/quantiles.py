"""Exact percentiles (linear interpolation) without gathering a column into one task.

Spark's exact ``percentile`` merges a value -> count map of the whole column in a
single task, so its memory grows with the number of distinct values.  Here,
for each group ``k`` (e.g. one group per profiled column):

1. ``value_counts``: the values reduced to ``(k, v, c)`` distinct values and counts (a hot
   value becomes one row, however many rows carry it), range-partitioned on ``(k, v)`` and
   written as Parquet with a folder ``_b`` per range;
2. one read of that table gives the counts per range (one row per range and group), whose running
   sums locate the range and offset of each wanted rank;
3. only the ranges holding wanted ranks are read again (dynamic partition pruning on ``_b``) and
   sorted, one window partition per range, to pick the exact values.

The table lies in the cluster's shared folder, so the input is scanned once and a lost
executor rereads the table, not the fact.  The path is the same at every size.  Rank
``h = (n-1)·p`` interpolates between ranks ``floor(h)`` and ``ceil(h)``.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from bazaar.session import shared_path

WIDE = "decimal(38,0)"


def grouped_percentiles(df: DataFrame, key: str, value: str, probs: list[float], ranges: int | None = None) -> DataFrame:
    """One row per group: ``key`` and ``p{i}`` (DOUBLE) = exact ``probs[i]`` percentile of ``value``.

    NULL values are ignored; a group with no values does not appear.  ``ranges`` is the number
    of ranges of the value table (default: the shuffle partitions of the session).
    """
    return percentiles_of_counts(value_counts(df, key, value, ranges), key, probs)


def counted(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, v, c)``: distinct non-NULL values per group with their counts."""
    return (df.where(F.col(value).isNotNull())
              .groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")))


def written_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """``counted`` written below the shared folder: the only read of the input, whatever is worked out from it."""
    counts = counted(df, key, value)
    path = shared_path(df.sparkSession, "counts", uuid.uuid4().hex)
    counts.write.parquet(path)
    return df.sparkSession.read.schema(counts.schema).parquet(path)


def value_counts(df: DataFrame, key: str, value: str, ranges: int | None = None) -> DataFrame:
    """``ranged(counted(df))``: the only pass over the input; every later step reads this table."""
    return ranged(counted(df, key, value), key, ranges)


def ranged(counts: DataFrame, key: str, ranges: int | None = None, observed: tuple[Observation, list[Column]] | None = None) -> DataFrame:
    """``(key, v, c, _vd, _b)``: a ``counted`` table written in ranges ``_b`` of ``(key, v)``.

    ``observed`` metrics over (key, v, c, _vd) are taken while the table is written, so that totals need no read.
    """
    spark = counts.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (counts.repartitionByRange(ranges, key, "v")
              .withColumn("_vd", F.col("v").cast("double")).withColumn("_b", F.spark_partition_id()))
    if observed:
        placed = placed.observe(observed[0], *observed[1])
    path = shared_path(spark, "value_counts", uuid.uuid4().hex)
    placed.write.partitionBy("_b").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def percentiles_of_counts(vc: DataFrame, key: str, probs: list[float], totals: dict[str, Column] | None = None) -> DataFrame:
    """``grouped_percentiles`` on a ``ranged`` table, with more sums over all rows of a group (``totals``) from the same read."""
    totals = totals or {}
    # Per-range counts and the rank at which each range starts.
    group = Window.partitionBy(key)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (vc.groupBy(key, "_b").agg(F.sum("c").alias("_bc"), *(F.sum(e).alias(t) for t, e in totals.items()))
                .withColumn("_end", F.sum("_bc").over(upto))
                .withColumn("_start", F.col("_end") - F.col("_bc"))
                .withColumn("_n", F.sum("_bc").over(group))
                .withColumns({t: F.sum(t).over(group) for t in totals}))

    # Wanted ranks per probability: floor and ceil of (n-1)·p, exact.
    def h(p):
        return (F.col("_n") - 1).cast(WIDE) * F.lit(Decimal(str(p)))

    wanted = []
    for p in probs:
        wanted += [F.floor(h(p)).cast(WIDE), F.ceil(h(p)).cast(WIDE)]
    # The ranges holding a wanted rank, with their start rank and the group size: two per probability and group at most.
    holds = F.lit(False)
    for r in wanted:
        holds = holds | ((F.col("_start") <= r) & (r < F.col("_end")))
    meta = ranges.where(holds).select(key, "_b", "_start", "_n", *totals)
    in_range = Window.partitionBy(key, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (vc.select(key, "_b", "v", "c").join(F.broadcast(meta), [key, "_b"])
                .withColumn("_cum", F.sum("c").over(in_range))
                .withColumn("_first", F.col("_start") + F.col("_cum") - F.col("c"))
                .withColumn("_last", F.col("_start") + F.col("_cum") - 1))
    picks = ranked.groupBy(key).agg(
        F.first("_n").alias("_n"), *(F.first(t).alias(t) for t in totals),
        *[F.max(F.when((F.col("_first") <= r) & (r <= F.col("_last")), F.col("v"))).alias(f"_r{i}")
          for i, r in enumerate(wanted)])
    out = []
    for i, p in enumerate(probs):
        a, b = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        out.append((a + (b - a) * (h(p) - F.floor(h(p)))).cast("double").alias(f"p{i}"))
    return picks.select(key, *totals, *out)


def exact_percentiles(df: DataFrame, col: str, probs: list[float], ranges: int | None = None) -> DataFrame:
    """One row: ``p{i}`` = exact ``probs[i]`` percentile of ``col``; no row when ``col`` is all NULL."""
    one = df.select(F.lit(0).alias("_k"), F.col(col).alias("_x"))
    return grouped_percentiles(one, "_k", "_x", probs, ranges).drop("_k")
