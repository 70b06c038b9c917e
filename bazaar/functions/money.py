"""Exact decimal arithmetic for money columns.

Sums stay in DECIMAL (never DOUBLE) so results do not depend on partitioning
or row order.  Ratios are rounded once from the exact quotient: both sides are
scaled to integers (DECIMAL(38,0)), and ``round(p / q, k)`` half up is
``floor((2·|p|·10^k + |q|) / (2·|q|))`` by exact integer division, with the sign
put back (half-even compares twice the remainder with ``|q|``).  Rounding a
DECIMAL average to 6 places and then to 2 can move a result by one cent once a
group has more than about a million rows; this never does.  Values are cast to
DOUBLE only at the end.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = T.DecimalType(38, 0)
EXACT_PLACES = 4  # inputs may carry at most this many decimals (money has 2)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _integer(c: Column) -> Column:
    """``c * 10^EXACT_PLACES`` as an exact DECIMAL(38,0) — both sides of a ratio get the same factor."""
    return (c.cast(T.DecimalType(34, EXACT_PLACES)) * F.lit(Decimal(10 ** EXACT_PLACES))).cast(WIDE)


def floor_div(a: Column, b: Column) -> Column:
    """Exact ``floor(a / b)`` for non-negative integral DECIMAL(38,0) ``a`` and positive ``b``.

    ``a % b`` is exact, and ``a - a % b`` is a multiple of ``b``, so the
    division yields an exact integer — each operand appears twice, which keeps
    the expression small.  (Spark's ``div`` would return BIGINT and overflow
    past 9.2e18.)
    """
    return ((a - a % b) / b).cast(WIDE)


def rounded_quotient(num, den, scale: int = 2, factor: int = 1, half_even: bool = False) -> Column:
    """Exact ``round(factor * num / den * 10^scale)`` as an integer DECIMAL(38,0).

    ``num`` and ``den`` are DECIMAL or integral columns with at most
    ``EXACT_PLACES`` decimals; every step is exact integer arithmetic on
    DECIMAL(38,0).  Ties go away from zero (SQL ``ROUND``) or, with
    ``half_even``, to the even neighbour (Python's format rounding).  NULL when
    either side is NULL or ``den`` is 0.
    """
    top = (_integer(_as_col(num)) * F.lit(factor * 10 ** scale)).cast(WIDE)
    bottom = _integer(_as_col(den))
    a, b = F.abs(top), F.nullif(F.abs(bottom), F.lit(0)).cast(WIDE)
    if half_even:
        rest = (a % b).cast(WIDE)
        q = ((a - rest) / b).cast(WIDE)
        twice = (rest * 2).cast(WIDE)
        magnitude = q + F.when((twice > b) | ((twice == b) & (q % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
    else:
        magnitude = floor_div((a * 2 + b).cast(WIDE), (b * 2).cast(WIDE))  # floor(|n/d| + 1/2)
    sign = F.when((top < 0) != (bottom < 0), F.lit(-1)).otherwise(F.lit(1))
    return (magnitude * sign).cast(WIDE)


def unscale(q: Column, scale: int) -> Column:
    """Integer count of ``10^-scale`` units -> exact DECIMAL with ``scale`` places."""
    return (q.cast(WIDE) * F.lit(Decimal(1).scaleb(-scale))).cast(T.DecimalType(38, scale))


def round_ratio(num, den, scale: int = 2, factor: int = 1, half_even: bool = False) -> Column:
    """Exact ``round(factor * num / den, scale)`` as DOUBLE (see ``rounded_quotient``)."""
    return unscale(rounded_quotient(num, den, scale, factor, half_even), scale).cast("double")


def money_total(c) -> Column:
    """SUM that is 0 instead of NULL for an empty or all-NULL group (the EDA rule)."""
    return F.coalesce(F.sum(_as_col(c)), F.lit(Decimal("0.00")))


def avg_money(c, scale: int = 2) -> Column:
    """Exact mean of the non-NULL values rounded to ``scale`` places (SQL ``ROUND(AVG(x), 2)``)."""
    return round_ratio(F.sum(_as_col(c)), F.count(_as_col(c)), scale=scale)
