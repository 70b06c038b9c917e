"""Load job: create -> full refresh -> reconcile.

One pass over the source writes every row once into a new version of the load table, partitioned by ``Status``
(``valid`` / ``quarantine``): valid rows carry their typed columns, quarantined rows their raw text and a
``Reason``, all of them their place in the source (file, split, number in the scan).  The source rows are counted
by an observed metric of that same pass, and compared with what the version then holds.

Versions are folders of their own (``sources.versions``), each with a catalog table over it.  A version that holds all
source rows is published: a marker file for other processes, and in the catalog one ``CREATE OR REPLACE VIEW`` of
``<db>.sales_load``, over which ``<db>.sales_data`` (partition pruning: its readers never touch the quarantine files) and
``<db>.sales_quarantine`` are views.  Until then, and when a write fails or loses rows, readers have the old rows; two
drivers never write to one folder.  A rerun replaces rather than appends.

``<db>.sales_rows`` is the table with its key: ``id`` numbers the source rows 1..n by file and line (A12).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.operators.clean import coerce
from bazaar.schema import COLUMNS, DATE_FORMATS, MAX_LENGTH, SALES_SCHEMA
from bazaar.session import shared_path
from bazaar.sources.csv import SOURCE_PLACE
from bazaar.sources.versions import Versions

VALID, QUARANTINE = "valid", "quarantine"
#: Published versions that stay: the current one, and one for readers that began before it.
KEEP = 2

_SQL_TYPES = {T.StringType: "STRING", T.DateType: "DATE", T.IntegerType: "INT"}


def _ddl_type(name: str, dt: T.DataType) -> str:
    if isinstance(dt, T.DecimalType):
        return f"DECIMAL({dt.precision},{dt.scale})"
    if name in MAX_LENGTH:
        return f"VARCHAR({MAX_LENGTH[name]})"  # Spark checks the length on every write
    return _SQL_TYPES[type(dt)]


def ensure_database(spark: SparkSession, db: str, location: str | None = None, warehouse: str | None = None) -> str:
    """``CREATE DATABASE IF NOT EXISTS``; returns its location.

    ``warehouse`` is the folder of lasting tables, shared by the cluster; without one the tables
    lie in the shared folder of intermediate tables and live as long as that.
    """
    location = location or (f"{warehouse.rstrip('/')}/{db}.db" if warehouse else shared_path(spark, "warehouse", f"{db}.db"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}` LOCATION '{location}'")
    return location


def _versions(spark: SparkSession, db: str) -> Versions:
    return Versions(spark, f"{spark.catalog.getDatabase(db).locationUri}/sales_load")


def version_table(spark: SparkSession, db: str, version: str) -> str:
    """Create the catalog table over a version's folder, if it is not there; returns its name."""
    name, folder = f"`{db}`.`sales_load_{version}`", _versions(spark, db).folder(version)
    typed = ", ".join(f"`{f.name}` {_ddl_type(f.name, f.dataType)}" for f in SALES_SCHEMA.fields)
    raw = ", ".join(f"`raw_{c}` STRING" for c in COLUMNS)
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name}
                  (`src_file` STRING, `src_block` BIGINT, `src_row` BIGINT, {typed}, `Reason` STRING, {raw}, `Status` STRING)
                  USING parquet PARTITIONED BY (`Status`) LOCATION '{folder}/rows'""")
    return name


def _show(spark: SparkSession, db: str, version: str) -> None:
    """Let the database's views show a version."""
    table, folder = version_table(spark, db, version), _versions(spark, db).folder(version)
    spark.sql(f"CREATE OR REPLACE VIEW `{db}`.`sales_load` AS SELECT * FROM {table}")
    cols = ", ".join(f"`{c}`" for c in COLUMNS)
    spark.sql(f"CREATE OR REPLACE VIEW `{db}`.`sales_data` AS "
              f"SELECT {cols} FROM `{db}`.`sales_load` WHERE `Status` = '{VALID}'")
    raw_as = ", ".join(f"`raw_{c}` AS `{c}`" for c in COLUMNS)
    spark.sql(f"CREATE OR REPLACE VIEW `{db}`.`sales_quarantine` AS "
              f"SELECT {raw_as}, `Reason` FROM `{db}`.`sales_load` WHERE `Status` = '{QUARANTINE}'")
    spark.sql(f"CREATE OR REPLACE VIEW `{db}`.`sales_rows` AS "
              f"SELECT s.`first_id` + r.`src_row` - s.`first_row` AS `id`, r.* FROM {table} r JOIN parquet.`{folder}/splits` s "
              f"ON r.`src_file` = s.`src_file` AND r.`src_block` = s.`src_block`")


def ensure_tables(spark: SparkSession, db: str) -> None:
    """The views over the published version; an empty one is published if there is none."""
    versions = _versions(spark, db)
    version = versions.current()
    if version is None:
        nothing = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS]))
        version = versions.write(lambda v: _fill(spark, db, v, staged(nothing)))
    _show(spark, db, version)


def attach(spark: SparkSession, db: str, warehouse: str) -> None:
    """Register the tables that another session loaded below ``warehouse``."""
    ensure_database(spark, db, warehouse=warehouse)
    version = _versions(spark, db).current()
    if version is not None:
        version_table(spark, db, version)
        spark.catalog.recoverPartitions(f"`{db}`.`sales_load_{version}`")
    ensure_tables(spark, db)


def staged(raw: DataFrame, places: bool = True, date_formats: list[str] = DATE_FORMATS) -> DataFrame:
    """Rows in the load table's layout: typed values for valid rows, raw text for rejected ones.

    Rows of a source without files are placed by the partitions of its scan.  Streaming sources cannot number rows, so
    they pass ``places=False``.
    """
    if places and not set(SOURCE_PLACE) <= set(raw.columns):
        raw = raw.withColumns({"src_file": F.lit(""), "src_block": F.spark_partition_id().cast("bigint"),
                               "src_row": F.monotonically_increasing_id()})
    place = SOURCE_PLACE if places else []
    c = coerce(raw, date_formats, keep=place)
    ok = F.col("Reason").isNull()
    return c.select(*place, *[F.when(ok, F.col(x)).alias(x) for x in COLUMNS], "Reason",
                    *[F.when(~ok, F.col(f"raw_{x}")).alias(f"raw_{x}") for x in COLUMNS],
                    F.when(ok, F.lit(VALID)).otherwise(F.lit(QUARANTINE)).alias("Status"))


@contextmanager
def _both_files_open(spark: SparkSession) -> Iterator[None]:
    """Tasks write valid and quarantined rows side by side.  Otherwise Spark sorts each task's rows by ``Status`` before it
    writes them, which spills all columns of all rows where a task's rows do not fit its memory.  A task that reaches the limit
    sorts the rest of its rows, so it is above the two."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, max(int(before), 4))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _fill(spark: SparkSession, db: str, version: str, rows: DataFrame) -> None:
    """Write a version: its rows, and the splits they were read with."""
    table = version_table(spark, db, version)
    with _both_files_open(spark):
        rows.write.option("partitionOverwriteMode", "static").insertInto(table, overwrite=True)
    # A row per split: its first row's number in the scan, and its first id after all splits of smaller place.
    splits = spark.table(table).groupBy("src_file", "src_block").agg(F.min("src_row").alias("first_row"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("src_file", "src_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("first_id", 1 + F.coalesce(F.sum("rows").over(before), F.lit(0)))
    splits.write.mode("overwrite").parquet(f"{_versions(spark, db).folder(version)}/splits")


def _held(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).agg(F.count_if(F.col("Status") == VALID).alias("Loaded_Rows"),
                                  F.count_if(F.col("Status") == QUARANTINE).alias("Quarantined_Rows"))


def full_refresh(spark: SparkSession, raw: DataFrame, db: str, date_formats: list[str] = DATE_FORMATS) -> DataFrame:
    """Replace the load table's contents with ``raw`` (valid and quarantined rows, one pass) and return the reconciliation:
    one row Source_Rows, Loaded_Rows, Quarantined_Rows, Reconciled (source = loaded + quarantined).

    If it does not come out even, the old rows stay.
    """
    versions, seen, row = _versions(spark, db), Observation(), {}
    rows = staged(raw.observe(seen, F.count(F.lit(1)).alias("rows")), date_formats=date_formats)

    def whole(version: str) -> bool:
        loaded, rejected = _held(spark, version_table(spark, db, version)).first()
        row.update(Source_Rows=seen.get["rows"], Loaded_Rows=loaded, Quarantined_Rows=rejected)
        row["Reconciled"] = row["Source_Rows"] == loaded + rejected
        return row["Reconciled"]

    before, tried = set(versions.published()), []

    def fill(version: str) -> None:
        tried.append(version)
        _fill(spark, db, version, rows)

    try:
        version = versions.write(fill, whole)
        if version is not None:
            _show(spark, db, version)
            versions.drop_old(KEEP)
    finally:  # no catalog table outlives its folder
        for gone in {*before, *tried}.difference(versions.published()):
            spark.sql(f"DROP TABLE IF EXISTS `{db}`.`sales_load_{gone}`")
    return spark.range(1).select(*[F.lit(v).cast("boolean" if k == "Reconciled" else "bigint").alias(k) for k, v in row.items()])


def run(spark: SparkSession, raw: DataFrame, db: str = "sales_analytics", warehouse: str | None = None,
        date_formats: list[str] = DATE_FORMATS) -> DataFrame:
    """A10: create database and tables, load, and return the reconciliation row."""
    ensure_database(spark, db, warehouse=warehouse)
    ensure_tables(spark, db)
    return full_refresh(spark, raw, db, date_formats)


def sales_data(spark: SparkSession, db: str = "sales_analytics") -> DataFrame:
    return spark.table(f"`{db}`.`sales_data`")


def sales_rows(spark: SparkSession, db: str = "sales_analytics") -> DataFrame:
    """The load table with ``id``, the number of a row in its source by file and line: 1..n over valid and quarantined rows."""
    return spark.table(f"`{db}`.`sales_rows`")


def quarantine(spark: SparkSession, db: str = "sales_analytics") -> DataFrame:
    return spark.table(f"`{db}`.`sales_quarantine`")


def with_surrogate_key(df: DataFrame, name: str = "id") -> DataFrame:
    """Dense, unique, increasing ``1..n`` key in the scan's row order.

    ``monotonically_increasing_id`` is ``partition << 33 | row-in-partition``;
    rows per partition (one small aggregate, one row per partition) turn it
    into a dense number through a broadcast of that partition table, whose
    size is bounded by the partition count.  The input must be a
    deterministic scan (a file table), so a recomputed partition numbers its
    rows the same way.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright(F.col("_mid"), 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (tagged.join(F.broadcast(offsets), part == F.col("_part"))
                  .select((F.col("_offset") + within + 1).alias(name), *df.columns))
