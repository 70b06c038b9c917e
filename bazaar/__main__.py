"""Command line: the three things the original pipeline is run for.

    python -m bazaar load   --csv orders.csv [--jdbc-url URL] --db sales_analytics --warehouse DIR [--to-jdbc-url URL]
    python -m bazaar eda    (--db NAME --warehouse DIR | --csv PATH | --parquet PATH | --tables DIR) --out DIR
    python -m bazaar report NAME (--db NAME --warehouse DIR | --csv PATH | --parquet PATH | --tables DIR)

``load`` reads the database table when reachable, else the CSV, coerces and
quarantines, fully refreshes ``<db>.sales_load`` and prints the reconciliation.
``eda`` writes every EDA section (Parquet) and the report tables (Markdown).
``report`` prints one registered report.  ``--warehouse`` is the folder of the loaded
tables; a later process finds them there.  Reports on a file keep every row of it; rows are
rejected by ``load`` only.  Database credentials come from the
``--jdbc-user`` / ``--jdbc-password-file`` options, never from code.
"""

from __future__ import annotations

import argparse
import sys
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from bazaar.functions.text import with_collation
from bazaar.operators.clean import report_rows
from bazaar.plans import catalog, eda_job, load_job
from bazaar.schema import DATE_FORMATS, DIMENSIONS
from bazaar.session import get_session, shared_path
from bazaar.sources.csv import read_sales_csv
from bazaar.sources.fallback import load_raw
from bazaar.sources.jdbc import JdbcSource, write_sales_jdbc
from bazaar.sources.tables import sales_table


def _fact(spark: SparkSession, args, reused: bool = False) -> DataFrame:
    """The sales rows to report on; a CSV read several times is coerced once and written as Parquet first."""
    if args.db:
        if args.warehouse:
            load_job.attach(spark, args.db, args.warehouse)
        return load_job.sales_data(spark, args.db)
    if args.parquet:
        return spark.read.parquet(args.parquet)
    if args.tables:
        return sales_table(spark, args.tables)
    rows = report_rows(read_sales_csv(spark, args.csv, args.multi_line), args.date_format or DATE_FORMATS)
    if not reused:
        return rows
    path = shared_path(spark, "cli", uuid.uuid4().hex[:12], "sales_data")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _jdbc(args) -> JdbcSource | None:
    if not args.jdbc_url:
        return None
    props = {}
    if args.jdbc_user:
        props["user"] = args.jdbc_user
    if args.jdbc_password_file:
        with open(args.jdbc_password_file) as fh:
            props["password"] = fh.read().strip()
    return JdbcSource(url=args.jdbc_url, table=args.jdbc_table, properties=props)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bazaar")
    p.add_argument("--master", default=None, help="Spark master (default: from the launcher)")
    sub = p.add_subparsers(dest="command", required=True)

    load = sub.add_parser("load", help="create, full-refresh and reconcile the sales table")
    load.add_argument("--csv")
    load.add_argument("--jdbc-url")
    load.add_argument("--jdbc-table", default="sales_data")
    load.add_argument("--jdbc-user")
    load.add_argument("--jdbc-password-file")
    load.add_argument("--db", default="sales_analytics")
    load.add_argument("--to-jdbc-url", help="also full-refresh this database table with the valid rows")
    load.add_argument("--to-jdbc-table", default="sales_data")

    for name in ("eda", "report"):
        sp = sub.add_parser(name)
        if name == "report":
            sp.add_argument("name", choices=sorted(catalog.REPORTS))
            sp.add_argument("--collation", help="compare group keys under this collation, e.g. UNICODE_CI_AI, as the database does")
        src = sp.add_mutually_exclusive_group(required=True)
        src.add_argument("--db")
        src.add_argument("--csv")
        src.add_argument("--parquet")
        src.add_argument("--tables", help="folder of star-schema tables (lineitem, orders, ...) joined into sales")
        if name == "eda":
            sp.add_argument("--out", required=True)
            sp.add_argument("--generated-at", default=None, help="report stamp, ISO time (default: now)")
    for sp in sub.choices.values():
        sp.add_argument("--warehouse", help="folder of the loaded tables (default: the session's catalog)")
        sp.add_argument("--multi-line", action="store_true", help="CSV fields may hold line breaks; each file is one task")
        sp.add_argument("--date-format", action="append", help="pattern of dates in a CSV; may be given several times")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    spark = spark or get_session(args.master)
    if args.command == "load":
        raw, used = load_raw(spark, _jdbc(args), args.csv, args.multi_line, places=True)
        print(f"source: {used}")
        load_job.run(spark, raw, args.db, args.warehouse, args.date_format or DATE_FORMATS).show(truncate=False)
        if args.to_jdbc_url:
            target = JdbcSource(url=args.to_jdbc_url, table=args.to_jdbc_table,
                                properties=_jdbc(args).properties if args.jdbc_url else {})
            write_sales_jdbc(load_job.sales_data(spark, args.db), target)
            print(f"database table {args.to_jdbc_table} refreshed")
    elif args.command == "eda":
        stamp = datetime.fromisoformat(args.generated_at) if args.generated_at else datetime.now()
        eda_job.run(_fact(spark, args, reused=True), out_dir=args.out, generated_at=stamp)
        print(f"sections written to {args.out}")
    else:
        fact = _fact(spark, args)
        if args.collation:
            fact = with_collation(fact, ["Gender", *DIMENSIONS], args.collation)
        catalog.REPORTS[args.name](fact).show(n=1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
