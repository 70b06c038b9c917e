"""Sources without any database: JDBC options, fallback order, CSV round trip."""

import pytest

from bazaar.operators.clean import coerce, valid_rows
from bazaar.sources.csv import read_sales_csv, write_sales_csv
from bazaar.sources.fallback import NoSourceError, load_raw
from bazaar.sources.jdbc import JdbcSource
from rows import row

DOWN = JdbcSource(url="jdbc:unreachable://localhost/db", properties={"user": "u"})


def test_partitioned_read_options():
    src = JdbcSource(url="jdbc:x://h/db", num_partitions=16, properties={"user": "u"})
    opts = src.read_options(1, 1000)
    assert opts["partitionColumn"] == "id" and opts["numPartitions"] == "16"
    assert (opts["lowerBound"], opts["upperBound"]) == ("1", "1001")
    assert opts["user"] == "u" and "partitionColumn" not in src.read_options(None, None)


def test_full_refresh_write_options():
    opts = JdbcSource(url="jdbc:x://h/db").write_options()
    assert opts["truncate"] == "true" and opts["dbtable"] == "sales_data"


def test_fallback_to_csv_and_roundtrip(spark, sales, tmp_path):
    df = sales(row(Order_ID="A", Age=None), row(Order_ID="B", City=None))
    path = str(tmp_path / "sales.csv")
    write_sales_csv(df, path)
    raw, used = load_raw(spark, DOWN, path)
    assert used == "csv"
    back = valid_rows(coerce(raw))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_no_source_raises(spark, tmp_path):
    with pytest.raises(NoSourceError):
        load_raw(spark, DOWN, str(tmp_path / "missing.csv"))


def test_csv_reader_keeps_text(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Order_ID,Order_Date,Customer_ID,Customer_Name,Age,Gender,City,Product,Category,Quantity,"
                 "Unit_Price,Total_Sales\nA1,2025-01-01,C,N,30.0,Male,Pune,Book,Education,2,5.00,1e3\n")
    r = read_sales_csv(spark, str(p)).first()
    assert (r.Age, r.Total_Sales) == ("30.0", "1e3")


def test_load_table_enforces_declared_lengths(spark, tmp_path):
    from bazaar.plans import load_job
    load_job.ensure_database(spark, "len_check", str(tmp_path / "db"))
    name = load_job.version_table(spark, "len_check", "a")
    table = spark.table(name)
    row = {c: None for c in table.columns}
    row.update(Order_ID="A", City="x" * 51, Status="valid")
    df = spark.createDataFrame([tuple(row[c] for c in table.columns)], table.schema)
    with pytest.raises(Exception, match="(?i)length"):
        df.write.insertInto(name)


def test_jdbc_partitions_follow_the_key_range():
    src = JdbcSource(url="jdbc:x://h/db", rows_per_partition=1000)
    assert [src.partitions(1, n) for n in (1, 1000, 1001, 10**9)] == [1, 1, 2, 10**6]
    assert "numPartitions" not in src.read_options(1, 1000)
    assert src.read_options(1, 5000)["numPartitions"] == "5"
