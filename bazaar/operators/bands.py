"""Age bands of the EDA half.

Left-closed bins ``[0,20) [20,30) … [60,70)``; NULL ages and ages outside
``[0, 70)`` are dropped, and every band is reported, zero when empty.  (The
SQL half's CASE bands, which put 70+ and negatives in the end bands, are
``reports.age_band_revenue``.)  One global aggregate of six conditional
counts, unpacked into six rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.schema import EDA_AGE_EDGES, EDA_AGE_LABELS


def eda_age_band(age: Column) -> Column:
    """Band index 0–5 for ``age`` in ``[0, 70)``, else NULL."""
    edges = EDA_AGE_EDGES
    expr = None
    for i in range(len(edges) - 1):
        cond = (age >= edges[i]) & (age < edges[i + 1])
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def band_aggs() -> list[Column]:
    """Aggregates behind ``age_band_counts`` (fusable with other global aggregates)."""
    band = eda_age_band(F.col("Age"))
    return [F.count_if(band == i).alias(f"_b{i}") for i in range(len(EDA_AGE_LABELS))]


def bands_of_counts(counts: DataFrame) -> DataFrame:
    """The row behind ``present_band_counts`` from a ``(v, c)`` table of ages."""
    band = eda_age_band(F.col("v"))
    return counts.agg(*[F.coalesce(F.sum(F.when(band == i, F.col("c"))), F.lit(0)).alias(f"_b{i}") for i in range(len(EDA_AGE_LABELS))])


def present_band_counts(row: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("Band_Index"), F.lit(label).alias("Age_Band"),
                              F.col(f"_b{i}").alias("Orders")) for i, label in enumerate(EDA_AGE_LABELS)])
    return row.select(F.inline(rows))


def age_band_counts(df: DataFrame) -> DataFrame:
    """Number of rows per age band, in band order, including empty bands."""
    return present_band_counts(df.agg(*band_aggs()))
