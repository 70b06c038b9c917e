"""Age histogram and kernel density (E13 chart data).

* ``age_histogram`` — 20 equal-width bins from min to max (last bin closed);
  when min = max the range is widened by ±0.5, so all rows land in the middle
  bin.  The bin of a value follows the usual equal-width rule including its
  correction against the computed edges.  The column is first reduced to
  distinct values with counts (written, so the fact is read once);
  min/max come in as a scalar subquery over them, and one global aggregate of
  conditional sums fills the bins — no join.  Each bin carries the age group of its left edge.
* ``age_density`` — Gaussian kernel density with Scott's bandwidth
  ``h = std · n^(-1/5)`` (sample std) at 300 equally spaced points from min to
  max.  The column is first reduced to distinct values with counts, so the
  work is ``distinct × 300`` whatever the row count; each distinct value emits
  its 300 kernel terms (``explode`` of a fixed grid, no join) and a partial
  aggregate per grid point sums them.  Fewer than two values or zero spread →
  no rows.
* ``binned_density`` — the same curve for a column of many values (amounts): linear binning onto a fine grid,
  whose size does not depend on the rows, then a convolution bounded to the kernel's reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.operators.quantiles import written_counts
from bazaar.schema import DENSITY_POINTS, HISTOGRAM_BANDS, HISTOGRAM_BINS


def histogram_band(left: Column) -> Column:
    """Label of a bar from its left edge."""
    *bounded, (_, rest) = HISTOGRAM_BANDS
    cases = [F.when(left < bound, F.lit(name)) for bound, name in bounded]
    return F.coalesce(*cases, F.lit(rest))


def histogram(df: DataFrame, col: str = "Age", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Rows ``Bin, Bin_Start, Bin_End, Orders, Age_Group``; none when the column is all NULL."""
    return histogram_from_counts(_counts_of(df, col), bins)


def _counts_of(df: DataFrame, col: str) -> DataFrame:
    """``(v, c)``: distinct values with counts — the only read of the fact."""
    return written_counts(df.select(F.lit(0).alias("_k"), F.col(col).alias("_v")), "_k", "_v").select("v", "c")


def histogram_from_counts(counts: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """The histogram from a ``(v, c)`` table of distinct values and counts."""
    vc = counts.select(F.col("v").cast("double").alias("_x"), F.col("c").alias("_c"))
    # min / max as one scalar subquery, bound once as a column.
    mm = vc.select(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    vc = vc.withColumn("_mm", mm)
    lo, hi = F.col("_mm.lo"), F.col("_mm.hi")
    first = F.when(lo == hi, lo - 0.5).otherwise(lo)
    last = F.when(lo == hi, hi + 0.5).otherwise(hi)

    def edge(i: Column) -> Column:
        step = (F.col("_last") - F.col("_first")) / F.lit(float(bins))
        return F.when(i == bins, F.col("_last")).otherwise(i.cast("double") * step + F.col("_first"))

    x, i = F.col("_x"), F.col("_i")
    norm = F.lit(float(bins)) / (F.col("_last") - F.col("_first"))
    placed = (vc.withColumn("_first", first).withColumn("_last", last)
                .withColumn("_i", F.floor((x - F.col("_first")) * norm).cast("int"))
                .withColumn("_i", F.when(i == bins, F.lit(bins - 1)).otherwise(i))
                .withColumn("_i", F.when(x < edge(i), i - 1).otherwise(i))
                .withColumn("_i", F.when((x >= edge(i + 1)) & (i != bins - 1), i + 1).otherwise(i)))
    counts = placed.agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"),
                        *[F.coalesce(F.sum(F.when(i == b, F.col("_c"))), F.lit(0)).alias(f"c{b}")
                          for b in range(bins)])
    rows = F.array(*[F.struct(F.lit(b).alias("Bin"), F.col(f"c{b}").alias("Orders")) for b in range(bins)])
    out = counts.select("_first", "_last", F.inline(rows))
    start, end = edge(F.col("Bin")), edge(F.col("Bin") + 1)
    return (out.select("Bin", start.alias("Bin_Start"), end.alias("Bin_End"), "Orders",
                       histogram_band(start).alias("Age_Group"))
               .where(F.col("Bin_Start").isNotNull()))


def age_histogram(df: DataFrame) -> DataFrame:
    """The age histogram bars."""
    return histogram(df, "Age")


def density(df: DataFrame, col: str = "Age", points: int = DENSITY_POINTS) -> DataFrame:
    """Rows ``Point, X, Density`` (both rounded to 10 places) of the kernel density of ``col``."""
    return density_from_counts(_counts_of(df, col), points)


def density_from_counts(counts: DataFrame, points: int = DENSITY_POINTS) -> DataFrame:
    """The kernel density from a ``(v, c)`` table of distinct values and counts."""
    t = counts.schema["v"].dataType
    if isinstance(t, (T.FloatType, T.DoubleType)):
        # Floating values: stable two-pass variance around the mean.
        vc = counts.select(F.col("v").cast("double").alias("a"), "c")
        mean = vc.select(F.sum(F.col("c") * F.col("a")) / F.sum("c")).scalar()
        spread = F.sum(F.col("c") * F.pow(F.col("a") - mean, 2)) / (F.sum("c") - 1)
    else:
        # Integral / decimal values: exact sums, (n·Σc·a² − (Σc·a)²) / (n(n−1)).
        scale = t.scale if isinstance(t, T.DecimalType) else 0
        vc = counts.select(F.col("v").cast(T.DecimalType(38, scale)).alias("a"), "c")
        n_, s1, s2 = (F.sum("c").cast("decimal(38,0)"), F.sum(F.col("c") * F.col("a")),
                      F.sum(F.col("c") * F.col("a") * F.col("a")))
        spread = (n_ * s2 - s1 * s1).cast("double") / (n_ * (n_ - 1)).cast("double")
    s = vc.select(F.struct(
        F.sum("c").cast("decimal(38,0)").alias("n"),
        F.min("a").cast("double").alias("lo"), F.max("a").cast("double").alias("hi"),
        F.when(F.sum("c") > 1, spread).alias("var"))).scalar()
    # The statistics come in as one scalar subquery, bound once as a column.
    st = F.col("_s")
    n, lo, hi, var = (st.getField(f) for f in ("n", "lo", "hi", "var"))
    j = F.col("Point")
    scaled = (vc.withColumn("_s", s)
                .where((n >= 2) & (var > 0))
                .select("a", "c", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("Point"),
                        lo.alias("_lo"), hi.alias("_hi"), n.cast("double").alias("_n"),
                        (F.sqrt(var) * F.pow(n.cast("double"), F.lit(-0.2))).alias("_h")))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(points - 1))
    x = F.when(j == points - 1, F.col("_hi")).otherwise(j.cast("double") * step + F.col("_lo"))
    terms = (scaled.withColumn("_x", x)
                   .withColumn("_z", (F.col("_x") - F.col("a").cast("double")) / F.col("_h"))
                   .select("Point", "_x", (F.col("c") * F.exp(F.lit(-0.5) * F.col("_z") * F.col("_z"))).alias("_k"),
                           (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))).alias("_norm")))
    return (terms.groupBy("Point", "_x").agg(F.sum("_k").alias("_k"), F.max("_norm").alias("_norm"))
                 .select("Point", F.round("_x", 10).alias("X"), F.round(F.col("_k") / F.col("_norm"), 10).alias("Density")))


def age_density(df: DataFrame) -> DataFrame:
    """The kernel density curve over the age range."""
    return density(df, "Age")


#: Cells of the fine grid of ``binned_density``, and the bandwidths beyond which a kernel counts as 0.
DENSITY_CELLS = 32_768
REACH = 8.5


def binned_density(df: DataFrame, col: str = "Total_Sales", points: int = DENSITY_POINTS, cells: int = DENSITY_CELLS) -> DataFrame:
    """Rows ``Point, X, Density, Error_Bound`` of the kernel density of ``col``, without a term per value and point.

    Each value is shared out between the two cells of a grid of ``cells`` points from min to max that it lies between, in
    proportion to its nearness; a task adds its rows up to one row per cell.  Each cell then adds its kernel to the
    points within ``REACH`` bandwidths: ``cells`` x ``points`` terms at most, however many rows there are.  Two reads of the one column: the
    moments, then the cells.

    ``Error_Bound`` bounds the distance from the direct sum: linear interpolation of a kernel over cells of width d
    is wrong by d² / 8 times its second derivative, which is 1 / (h³ √(2π)) at most, and a kernel beyond its reach is
    below exp(-REACH² / 2) / (h √(2π)).  Fewer than two values or zero spread: no rows.
    """
    x = F.col("_x")
    values = df.select(F.col(col).cast("double").alias("_x")).where(x.isNotNull())
    moments = values.select(F.struct(F.count(x).cast("double").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                                     F.stddev_samp(x).alias("sd"))).scalar()
    st = F.col("_s")
    n, lo, hi, sd = (st.getField(f) for f in ("n", "lo", "hi", "sd"))
    width = (hi - lo) / F.lit(float(cells - 1))
    place = (x - lo) / width
    cell = F.least(F.floor(place), F.lit(cells - 2)).cast("int")
    shared = (values.withColumn("_s", moments).where((n >= 2) & (sd > 0))
              .select("_s", cell.alias("_cell"), (place - cell).alias("_far"))
              .groupBy("_s", "_cell").agg(F.sum(1 - F.col("_far")).alias("_own"), F.sum("_far").alias("_next")))
    weights = shared.select("_s", F.inline(F.array(F.struct(F.col("_cell"), F.col("_own").alias("_w")),
                                                   F.struct((F.col("_cell") + 1).alias("_cell"), F.col("_next").alias("_w")))))
    weights = weights.groupBy("_s", "_cell").agg(F.sum("_w").alias("_w"))

    h = sd * F.pow(n, F.lit(-0.2))
    step = (hi - lo) / F.lit(float(points - 1))
    at = lo + F.col("_cell") * width
    first = F.greatest(F.ceil((at - REACH * h - lo) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((at + REACH * h - lo) / step), F.lit(points - 1)).cast("int")
    j = F.col("Point")
    point = F.when(j == points - 1, hi).otherwise(j.cast("double") * step + lo)
    # A point lies at most a step from some cell, but a reach below a step may hold none.
    terms = (weights.where(first <= last).withColumn("Point", F.explode(F.sequence(first, last))).withColumn("_z", (point - at) / h)
             .groupBy("Point", "_s").agg(F.sum(F.col("_w") * F.exp(F.lit(-0.5) * F.col("_z") * F.col("_z"))).alias("_k")))
    every = (df.sparkSession.range(points).select(F.col("id").cast("int").alias("Point"), moments.alias("_s")).where((n >= 2) & (sd > 0)))
    tops = math.sqrt(2 * math.pi)
    bound = (width * width / (8 * h * h) + math.exp(-REACH * REACH / 2)) / (h * tops)
    return (every.join(terms.select("Point", "_k"), "Point", "left")
                 .select("Point", point.alias("X"), (F.coalesce("_k", F.lit(0.0)) / (n * h * tops)).alias("Density"), bound.alias("Error_Bound")))


def sales_density(df: DataFrame) -> DataFrame:
    """The kernel density of the sales values at 300 points, to 8 places."""
    return binned_density(df, "Total_Sales").select("Point", F.round("X", 6).alias("X"), F.round("Density", 8).alias("Density"))
