"""The sales fact table built from the driver's star-schema test tables.

``sales_view`` is the lazy join; ``sales_table`` materialises it once into the
shared folder (``spark.checkpoint.dir``) as Parquet — the load job's output —
so every report scans one flat, column-pruned table instead of re-running four
joins.  The derived columns deterministically inject demographics, NULLs (keys included), a
nation without any sales value, ages outside the usual bands and the named category;
the same expressions are used by the SQL oracle.  Order lines whose order, customer,
nation or part is missing are kept, with NULLs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.schema import COLUMNS, MONEY, NAMED_CATEGORY, PRICE
from bazaar.session import shared_path
from bazaar.sources.versions import Files, Versions, written_once

SOURCE_TABLES = ["lineitem", "orders", "customer", "nation", "part"]
ADAPTER_VERSION = "5"
UNSOLD_NATION = 7  # the nation of which no order has a sales value


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy join ``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part`` → 12 sales columns.

    Join order is chosen for scale: ``customer ⋈ nation`` first (nation is a
    25-row dimension, so the size check broadcasts it), then ``orders`` (a
    quarter of lineitem's rows) joins customers, and only then does lineitem
    meet the narrow result on the order key.  ``part`` joins last on the part
    key; Spark broadcasts it when its size estimate is under the threshold and
    sort-merge joins otherwise.  Only the needed columns are read.
    """
    t = lambda name: read_table(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", "n_name")
    customer = (t("customer").select("c_custkey", "c_name", "c_nationkey")
                .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    orders = (t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
              .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left"))
    part = t("part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    joined = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
              .join(part, F.col("l_partkey") == F.col("p_partkey"), "left"))
    ok, ck, pk, line = F.col("l_orderkey"), F.col("o_custkey"), F.col("l_partkey"), F.col("l_linenumber")
    unsold = ((line == 7) & (ok % 29 == 0)) | F.coalesce(F.col("n_nationkey") == UNSOLD_NATION, F.lit(False))
    return joined.select(
        F.concat(ok.cast("string"), F.lit("-"), line.cast("string")).alias("Order_ID"),
        F.when(ok % 41 != 0, F.to_date(F.col("o_orderdate"))).alias("Order_Date"),
        ck.cast("string").alias("Customer_ID"),
        F.col("c_name").alias("Customer_Name"),
        F.when(ck % 61 == 0, F.lit(-1)).when(ck % 67 == 0, F.lit(12))
         .when(ck % 23 != 0, (F.lit(16) + ck % 60).cast("int")).alias("Age"),
        F.when(ck % 59 != 0, F.when(ck % 2 == 0, F.lit("Male")).otherwise(F.lit("Female"))).alias("Gender"),
        F.when(ok % 43 != 0, F.col("n_name")).alias("City"),
        F.when(pk % 53 != 0, F.col("p_name")).alias("Product"),
        F.when(pk % 47 != 0, F.when(F.col("p_type") == "ECONOMY", F.lit(NAMED_CATEGORY)).otherwise(F.col("p_type")))
         .alias("Category"),
        F.when(~((line == 6) & (ok % 31 == 0)), F.col("l_quantity").cast("int")).alias("Quantity"),
        F.when(pk % 71 != 0, F.col("p_retailprice").cast(PRICE)).alias("Unit_Price"),
        F.when(~unsold, F.col("l_extendedprice").cast(MONEY)).alias("Total_Sales"),
    )


def fingerprint(sf_dir: str, spark: SparkSession) -> str:
    """Identity of the input tables: path, total size, file count and modification time of each."""
    root = sf_dir.rstrip("/")
    files = Files(spark, root)
    h = hashlib.sha1(ADAPTER_VERSION.encode())
    h.update(root.encode())
    for name in SOURCE_TABLES:
        h.update(f"{name}:{files.state(f'{root}/{name}.parquet')}".encode())
    return h.hexdigest()[:16]


def _table_root(spark: SparkSession, sf_dir: str) -> str:
    return shared_path(spark, "sales_data", fingerprint(sf_dir, spark))


def sales_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, written once per input into the shared folder and read back.

    The write is an ordinary Spark job (task retries and the output committer
    make it survive executor loss) into a folder of this driver's, published when it is whole.
    Reading it back cuts the join lineage for every later report.
    """
    path = written_once(spark, _table_root(spark, sf_dir), lambda folder: sales_view(spark, sf_dir).write.parquet(folder))
    return spark.read.parquet(path).select(*COLUMNS)


def sales_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact rows for a job that reads them once: the written table if there is one, else the join itself."""
    written = Versions(spark, _table_root(spark, sf_dir)).current() is not None
    return sales_table(spark, sf_dir) if written else sales_view(spark, sf_dir)
