"""Per-dimension summaries shared by every EDA breakdown.

A *summary* has one row per non-NULL key and the columns ``_rev`` (DECIMAL
revenue, 0 when all sales are NULL), ``_n`` (non-NULL sales), ``_units``
(units, 0 when none), ``_ids`` (non-NULL order ids) and ``_rows`` (rows).
``dim_summary`` builds one from the fact with one aggregate; ``rollup`` builds
all of them plus the overall row in a single scan with GROUPING SETS, and
``from_rollup`` cuts one back out.  Presentation code only ever sees the
summary shape, so the one-pass job and the single reports share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.money import money_total
from bazaar.schema import NUMERIC_PROFILE_COLUMNS

SALES = "Total_Sales"
MONTH = "Month_Num"
ROLLUP_DIMS = ["Category", "City", "Product", MONTH]
SUMMARY_COLUMNS = ["_rev", "_n", "_units", "_ids", "_rows"]


def summary_aggs() -> list[Column]:
    return [money_total(SALES).alias("_rev"),
            F.count(SALES).alias("_n"),
            F.coalesce(F.sum("Quantity"), F.lit(0)).cast("bigint").alias("_units"),
            F.count("Order_ID").alias("_ids"),
            F.count(F.lit(1)).alias("_rows")]


def key_column(dim: str) -> Column:
    return F.month("Order_Date") if dim == MONTH else F.col(dim)


def dim_summary(df: DataFrame, dim: str) -> DataFrame:
    key = key_column(dim)
    return df.where(key.isNotNull()).groupBy(key.alias(dim)).agg(*summary_aggs())


def rollup(df: DataFrame, dims: list[str] = ROLLUP_DIMS) -> DataFrame:
    """One scan: a summary per dimension plus the overall row (``_gid`` tells them apart).

    The Expand before the partial aggregate multiplies rows by ``len(dims)+1``
    inside each task; the shuffle still carries only one row per key per task.
    """
    return _grouped(df, {d: key_column(d) for d in dims}, [])


def _grouped(df: DataFrame, keys: dict[str, Column], counted: list[str]) -> DataFrame:
    base = df.select(*[c.alias(k) for k, c in keys.items()], SALES, "Quantity", "Order_ID", "Order_Date", *counted)
    return base.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        *summary_aggs(), F.min("Order_Date").alias("_dmin"), F.max("Order_Date").alias("_dmax"),
        *[F.count(c).alias(f"_c_{c}") for c in counted], F.grouping_id().alias("_gid"))


def value_key(column: str) -> str:
    return f"_v_{column}"


def full_rollup(df: DataFrame, dims: list[str] = ROLLUP_DIMS, values: list[str] = NUMERIC_PROFILE_COLUMNS) -> tuple[DataFrame, list[str]]:
    """Everything the EDA job needs of the fact in a single aggregate over a single scan, and the list of its keys.

    Next to the sets of ``rollup`` it has one set per column of ``values`` (key ``value_key``; ``_rows`` is the number of rows of
    a value, NULL included), and the numbers of non-NULL values of all other columns as ``_c_<column>``.
    """
    keys = {d: key_column(d) for d in dims} | {value_key(c): F.col(c) for c in values}
    known = {*dims, *values, "Order_Date", "Order_ID"}
    return _grouped(df, keys, [c for c in df.columns if c not in known]), list(keys)


def missing_from_rollup(r: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row with ``Rows`` and the NULL count ``_m{i}`` of each column, from a ``full_rollup``."""
    whole = F.col("_gid") == grouping_code(keys, None)

    def missing(c: str) -> Column:
        key = MONTH if c == "Order_Date" else value_key(c) if value_key(c) in keys else c
        if key in keys:  # rows of the NULL key
            return F.sum(F.when((F.col("_gid") == grouping_code(keys, key)) & F.col(key).isNull(), F.col("_rows")))
        return F.sum(F.when(whole, F.col("_rows") - F.col("_ids" if c == "Order_ID" else f"_c_{c}")))

    return r.agg(F.sum(F.when(whole, F.col("_rows"))).alias("Rows"),
                 *[F.coalesce(missing(c), F.lit(0)).alias(f"_m{i}") for i, c in enumerate(columns)])


def values_from_rollup(r: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """``(v, c)``: the non-NULL values of ``column`` with their numbers of rows, from a ``full_rollup``."""
    key = value_key(column)
    return r.where((F.col("_gid") == grouping_code(keys, key)) & F.col(key).isNotNull()).select(F.col(key).alias("v"), F.col("_rows").alias("c"))


def grouping_code(dims: list[str], dim: str | None) -> int:
    full = (1 << len(dims)) - 1
    return full if dim is None else full - (1 << (len(dims) - 1 - dims.index(dim)))


def key_list(dims: list[str], dim: str) -> Column:
    """The non-NULL keys of one set of a rollup by ``dims`` (one row per key), in order and joined by ", "; NULL if there are none."""
    return F.expr(f"listagg(CASE WHEN `_gid` = {grouping_code(dims, dim)} THEN CAST(`{dim}` AS STRING) END, ', ') "
                  f"WITHIN GROUP (ORDER BY CAST(`{dim}` AS STRING))")


def from_rollup(r: DataFrame, dim: str, dims: list[str] = ROLLUP_DIMS) -> DataFrame:
    """The summary of ``dim`` (NULL keys dropped, as the EDA reports do)."""
    return (r.where((F.col("_gid") == grouping_code(dims, dim)) & F.col(dim).isNotNull())
             .select(dim, *SUMMARY_COLUMNS))


def overall_from_rollup(r: DataFrame, dims: list[str] = ROLLUP_DIMS) -> DataFrame:
    """The single overall row: ``_rev _n _units _ids _rows _dmin _dmax``."""
    return r.where(F.col("_gid") == grouping_code(dims, None)).select(*SUMMARY_COLUMNS, "_dmin", "_dmax")
