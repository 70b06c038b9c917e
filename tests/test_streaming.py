"""The incremental load takes each file once and splits valid / quarantined rows."""

from pyspark.sql import functions as F

from bazaar.sources.csv import write_sales_csv
from bazaar.sources.tables import sales_table
from bazaar.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_incremental_load_exactly_once(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    fact = sales_table(spark, SF)
    write_sales_csv(fact, str(src / "batch1"))
    q = ingest.start(spark, str(src / "*"), str(out), str(ckpt))
    q.awaitTermination(120)
    first = spark.read.parquet(str(out))
    assert first.where(F.col("Status") == "valid").count() == fact.count()
    # Rerun with no new files: nothing is loaded twice.
    q = ingest.start(spark, str(src / "*"), str(out), str(ckpt))
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == fact.count()
    # A new file with one bad row: only the new rows arrive, the bad one in quarantine.
    (src / "batch2").mkdir()
    (src / "batch2" / "part.csv").write_text(
        "Order_ID,Order_Date,Customer_ID,Customer_Name,Age,Gender,City,Product,Category,Quantity,Unit_Price,"
        "Total_Sales\nZ1,2025-01-01,C,N,29.5,Male,Pune,Book,Education,1,5.00,5.00\n")
    q = ingest.start(spark, str(src / "*"), str(out), str(ckpt))
    q.awaitTermination(120)
    loaded = spark.read.parquet(str(out))
    assert loaded.count() == fact.count() + 1
    bad = loaded.where(F.col("Status") == "quarantine").collect()
    assert [(r.raw_Order_ID, r.Reason) for r in bad] == [("Z1", "fractional_age")]
