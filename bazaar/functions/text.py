"""Text helpers for group keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Case- and accent-insensitive, like the database collation the SQL reports were
# written against.  Spark's default (UTF8_BINARY) compares bytes.
CASE_INSENSITIVE = "UNICODE_CI_AI"


def with_collation(df: DataFrame, columns: list[str], collation: str = CASE_INSENSITIVE) -> DataFrame:
    """Give ``columns`` a collation so grouping, joins and ordering on them follow it.

    ``Pune`` and ``PUNE`` then fall into one group.  The grouping stays a hash
    aggregate on a collation-aware key, so nothing else in a plan changes.
    """
    return df.withColumns({c: F.collate(F.col(c), collation) for c in columns})
