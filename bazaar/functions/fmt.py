"""Report text: currency, millions and percent labels (Column -> Column).

Numbers are rounded exactly from DECIMAL values with Python's rule for format
specs (ties to even), then printed from the exact rounded value, so a label
never depends on binary floating point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaar.functions.money import rounded_quotient, unscale
from bazaar.schema import CURRENCY_PREFIX


def _negative(num: Column, den: Column | None = None) -> Column:
    neg = num < 0
    return neg if den is None else (neg != (den < 0)) & (num != 0)


def signed(text: Column, q: Column, negative: Column) -> Column:
    """Python keeps the sign of a negative value that rounds to zero (``-0``, ``-0.0``)."""
    return F.concat(F.when(negative & (q == 0), F.lit("-")).otherwise(F.lit("")), text)


def grouped(q: Column, decimals: int) -> Column:
    """Exact decimal text with thousands separators: ``1234567.5`` -> ``1,234,567.5``."""
    return F.format_number(unscale(q, decimals), decimals)


def plain(q: Column, decimals: int) -> Column:
    """Exact decimal text without separators."""
    return unscale(q, decimals).cast("string")


def number(amount: Column, decimals: int = 0) -> Column:
    """``{x:,.Nf}`` of a DECIMAL amount."""
    q = rounded_quotient(amount, F.lit(1), scale=decimals, half_even=True)
    return signed(grouped(q, decimals), q, _negative(amount))


def rupees(amount: Column, decimals: int = 0) -> Column:
    """``Rs.{x:,.Nf}`` of a DECIMAL amount."""
    return F.concat(F.lit(CURRENCY_PREFIX), number(amount, decimals))


def rupees_of_ratio(num: Column, den: Column, decimals: int = 0) -> Column:
    """``Rs.{num/den:,.Nf}``, e.g. a mean sale, rounded from the exact quotient."""
    q = rounded_quotient(num, den, scale=decimals, half_even=True)
    return F.concat(F.lit(CURRENCY_PREFIX), signed(grouped(q, decimals), q, _negative(num, den)))


def millions(amount: Column, decimals: int = 1, suffix: str = "M") -> Column:
    """``Rs.{x/1e6:.Nf}M`` of a DECIMAL amount (no thousands separators)."""
    q = rounded_quotient(amount, F.lit(1_000_000), scale=decimals, half_even=True)
    return F.concat(F.lit(CURRENCY_PREFIX), signed(plain(q, decimals), q, _negative(amount)), F.lit(suffix))


def percent(num: Column, den: Column, decimals: int = 1) -> Column:
    """``{100*num/den:.Nf}%``."""
    q = rounded_quotient(num, den, scale=decimals, factor=100, half_even=True)
    return F.concat(signed(plain(q, decimals), q, _negative(num, den)), F.lit("%"))


def pad_right(text: Column, width: int) -> Column:
    """``{s:<width}``: pad with spaces on the right, never cut (``rpad`` alone would truncate)."""
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def pad_left(text: Column, width: int) -> Column:
    """``{s:>width}``: pad with spaces on the left, never cut."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def report_timestamp(ts: Column) -> Column:
    """``21 June 2026, 08:14`` — the report's generation stamp (passed in, so runs are reproducible)."""
    return F.date_format(ts, "dd MMMM yyyy, HH:mm")
