"""Permissive, null-safe coercion of raw text rows and the quarantine split.

Every field arrives as text.  Rules:

* text equal (after trimming) to one of ``NA_TOKENS`` is NULL in every column; other text is
  kept as it stands, blanks around it included;
* numbers must look like a decimal literal (optional sign, digits, optional
  fraction and exponent) — ``'7d'``, ``'1,000'``, ``'inf'``, ``'nan'`` are NULL,
  although a bare ``try_cast`` would read ``'7d'`` as 7.0;
* ``Age`` / ``Quantity`` are whole numbers in the load table: ``'30.0'`` is 30, a fractional
  value or one beyond INT sends the row to quarantine;
* money is DECIMAL, rounded half up to two places (``'10.555'`` -> 10.56); a number
  beyond its precision sends the row to quarantine;
* ``Order_Date`` tries each date format in order (``DATE_FORMATS``, or those the caller
  gives); impossible dates (``2025-02-30``) and other text are NULL;
* a row that the CSV reader could not split into its columns is quarantined as ``malformed``;
* ``Order_ID`` must be present and at most 20 characters, other text columns at
  most their declared length — otherwise the row is quarantined with a reason.

These limits belong to the load table.  Reports that read a file directly use
``report_rows``, which keeps every row: whole or fractional numbers, texts of any length,
missing ids.

All of it is per-row column arithmetic inside whole-stage codegen; nothing
is collected.  ``coerce`` keeps the raw text next to the typed value so valid
rows and quarantined rows come out of a single pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.schema import COLUMNS, DATE_FORMATS, MALFORMED, MAX_LENGTH, MONEY, NA_TOKENS, PRICE, REPORT_MONEY, REPORT_NUMBER

NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INT_LIMIT = 2 ** 31
AMOUNTS = {"Unit_Price": PRICE, "Total_Sales": MONEY}  # of the load table


def na_to_null(text: Column) -> Column:
    """NULL when the trimmed text is a missing-value token, else the text as it stands."""
    t = F.trim(text)
    return F.when(t.isNull() | t.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(text)


def number(text: Column) -> Column:
    """DOUBLE of a decimal literal, NULL for anything else (missing-value tokens and inf / nan included)."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def whole(d: Column) -> tuple[Column, Column, Column]:
    """(INT value, is-fractional flag, beyond-INT flag) of a ``number``."""
    fractional = d.isNotNull() & (d != F.floor(d))
    beyond = d.isNotNull() & (F.abs(d) >= INT_LIMIT)
    value = F.when(~beyond & ~fractional, d.cast("int"))
    return value, fractional, beyond


def money(text: Column, dtype=MONEY) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast(dtype))


def money_beyond(text: Column, dtype=MONEY) -> Column:
    """Whether the text is a number that ``dtype`` cannot hold."""
    return F.coalesce(F.trim(text).rlike(NUMBER_PATTERN), F.lit(False)) & money(text, dtype).isNull()


def date_of(text: Column, formats: list[str] = DATE_FORMATS) -> Column:
    t = F.trim(na_to_null(text))
    return F.to_date(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]))


def format_counts(raw: DataFrame, formats: list[str], column: str = "Order_Date") -> DataFrame:
    """Rows ``Position, Format, Parsed``: how many values of the column each format reads, from one aggregate."""
    t = F.trim(na_to_null(F.col(column)))
    row = raw.agg(*[F.count(F.try_to_timestamp(t, F.lit(f))).alias(f"_n{i}") for i, f in enumerate(formats)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("Position"), F.lit(f).alias("Format"), F.col(f"_n{i}").alias("Parsed"))
                                         for i, f in enumerate(formats)])))


def best_format(raw: DataFrame, formats: list[str], column: str = "Order_Date") -> Column:
    """The format that reads most values (ties: the earlier of the list), as a scalar subquery; row order has no say in it."""
    best = F.min(F.struct((-F.col("Parsed")).alias("less"), "Position", "Format"))
    return format_counts(raw, formats, column).select(best.getField("Format")).scalar()


def with_one_date_format(raw: DataFrame, formats: list[str], column: str = "Order_Date") -> DataFrame:
    """``raw`` whose dates of the format that reads most of them are written as yyyy-MM-dd; all other dates are NULL.

    For files whose dates several formats can read (03/04/2025): a file has one format, not one per row.
    """
    t = F.trim(na_to_null(F.col(column)))
    chosen = raw.withColumn("_format", best_format(raw, formats, column))
    read = F.lit(None).cast("date")
    for f in formats:
        read = F.when(F.col("_format") == f, F.to_date(F.try_to_timestamp(t, F.lit(f)))).otherwise(read)
    return chosen.withColumn(column, read.cast("string")).drop("_format")


def coerce(raw: DataFrame, date_formats: list[str] = DATE_FORMATS, keep: list[str] = ()) -> DataFrame:
    """Typed sales columns + ``Reason`` (NULL for a valid row) + the raw text as ``raw_<col>``.

    ``raw`` has the twelve business columns as strings; of other columns only the CSV
    reader's ``MALFORMED`` is looked at, and those of ``keep`` are passed on.
    """
    malformed = F.col(MALFORMED).isNotNull() if MALFORMED in raw.columns else F.lit(False)
    # Two steps: the fields are parsed once each, the rules then look at parsed values.  Rules over the texts themselves
    # would parse every field once per mention, in one method too long for the JVM to compile.
    parsed = raw.select(
        *keep, *[F.col(c).alias(f"raw_{c}") for c in COLUMNS], malformed.alias("_broken"),
        *[na_to_null(F.col(c)).alias(c) for c in MAX_LENGTH],
        *[number(F.col(c)).alias(f"_{c}") for c in ("Age", "Quantity")],
        *[money(F.col(c), kind).alias(c) for c, kind in AMOUNTS.items()],
        *[money_beyond(F.col(c), kind).alias(f"_{c}_beyond") for c, kind in AMOUNTS.items()],
        date_of(F.col("Order_Date"), date_formats).alias("Order_Date"))
    age, age_frac, age_beyond = whole(F.col("_Age"))
    qty, qty_frac, qty_beyond = whole(F.col("_Quantity"))
    too_long = reduce(Column.__or__, [F.length(c) > n for c, n in MAX_LENGTH.items() if c != "Order_ID"])
    reason = (F.when(F.col("_broken"), F.lit("malformed"))
               .when(F.col("Order_ID").isNull(), F.lit("order_id_null"))
               .when(F.length("Order_ID") > MAX_LENGTH["Order_ID"], F.lit("order_id_length"))
               .when(age_frac, F.lit("fractional_age"))
               .when(qty_frac, F.lit("fractional_quantity"))
               .when(age_beyond | qty_beyond, F.lit("integer_overflow"))
               .when(reduce(Column.__or__, [F.col(f"_{c}_beyond") for c in AMOUNTS]), F.lit("money_overflow"))
               .when(F.coalesce(too_long, F.lit(False)), F.lit("text_length")))
    typed = {"Age": age, "Quantity": qty}
    return parsed.select(*keep, *[typed.get(c, F.col(c)).alias(c) for c in COLUMNS], reason.alias("Reason"),
                         *[f"raw_{c}" for c in COLUMNS])


def report_rows(raw: DataFrame, date_formats: list[str] = DATE_FORMATS) -> DataFrame:
    """Every row of ``raw`` with typed columns, as the reports on a file read it: nothing is rejected.

    Age and Quantity keep a fraction (six places) and amounts may be larger than the load table's (16 digits before the point); text is
    only turned to NULL where it is a missing-value token, numbers and dates where they are none.
    """
    kind = {"Age": REPORT_NUMBER, "Quantity": REPORT_NUMBER, "Unit_Price": REPORT_MONEY, "Total_Sales": REPORT_MONEY}
    typed = {c: money(F.col(c), kind[c]) if c in kind else na_to_null(F.col(c)) for c in COLUMNS}
    typed["Order_Date"] = date_of(F.col("Order_Date"), date_formats)
    return raw.select(*[typed[c].alias(c) for c in COLUMNS])


def _with_reason(coerced: DataFrame, columns: list[str], rejected: bool) -> DataFrame:
    # A struct that is unpacked keeps the filter behind the parsing; moved before it, it would parse every field again.
    rows = coerced.select(F.inline(F.array(F.struct("Reason", *columns))))
    return rows.where(F.col("Reason").isNotNull() if rejected else F.col("Reason").isNull())


def valid_rows(coerced: DataFrame) -> DataFrame:
    return _with_reason(coerced, COLUMNS, rejected=False).select(*COLUMNS)


def quarantined_rows(coerced: DataFrame) -> DataFrame:
    """The rejected rows as their raw text plus ``Reason``."""
    return _with_reason(coerced, [f"raw_{c}" for c in COLUMNS], rejected=True).select(
        *[F.col(f"raw_{c}").alias(c) for c in COLUMNS], "Reason")
