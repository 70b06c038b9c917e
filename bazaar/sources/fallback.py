"""Source preference with fallback (A3 / E9): the database table first, else the CSV.

Spark fetches a JDBC table's schema when the read is declared, so an
unreachable database fails right there and the CSV is used instead.  Only a failing
connection or a missing driver means that; a wrong password, table or column is an
error of the caller and is raised.  When
neither source is usable an error is raised (the caller decides how to exit).
Either way the result is the raw text rows, ready for ``operators.clean``.
"""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from bazaar.sources.csv import read_sales_csv
from bazaar.sources.jdbc import JdbcSource, read_sales_jdbc
from bazaar.sources.versions import Files

log = logging.getLogger(__name__)


class NoSourceError(RuntimeError):
    pass


def unreachable(exc: BaseException) -> bool:
    """Whether a JDBC read failed for want of a driver or a connection (SQLSTATE class 08)."""
    cause = exc.java_exception if isinstance(exc, Py4JJavaError) else getattr(exc, "_origin", None)
    while cause is not None:
        name = cause.getClass().getName()
        if name.startswith("java.net.") or name == "java.lang.ClassNotFoundException":
            return True
        if name.startswith("java.sql.SQL") and (cause.getSQLState() or "").startswith("08"):
            return True
        cause = cause.getCause()
    return False


def load_raw(spark: SparkSession, jdbc: JdbcSource | None, csv_path: str | None,
             multi_line: bool = False, places: bool = False) -> tuple[DataFrame, str]:
    """``(raw rows, "jdbc" | "csv")``."""
    if jdbc is not None:
        try:
            return read_sales_jdbc(spark, jdbc), "jdbc"
        except Exception as exc:
            if not unreachable(exc):
                raise
            log.warning("database source unavailable, falling back to CSV: %s", str(exc).split("\n", 1)[0])
    if csv_path is not None and Files(spark, csv_path).exists(csv_path):
        return read_sales_csv(spark, csv_path, multi_line, places), "csv"
    raise NoSourceError(f"no usable source: database unavailable and CSV {csv_path!r} not found")
