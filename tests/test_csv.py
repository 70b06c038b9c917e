"""CSV dialect: columns by header name, standard quoting, malformed rows, line breaks."""

import pytest

from bazaar.operators.clean import coerce, quarantined_rows, valid_rows
from bazaar.sources.csv import read_sales_csv, write_sales_csv
from rows import row

HEADER = "id,Category,City,Order_ID,Order_Date,Customer_ID,Customer_Name,Age,Gender,Product,Quantity,Unit_Price,Total_Sales\n"


def test_columns_are_found_by_name_and_quotes_are_doubled(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEADER + '7,Education,Pune,A,2025-01-01,C,"N ""x"", y",30,Male,"Monitor 24"", black",2,5.00,10.00\n')
    r = read_sales_csv(spark, str(path)).first()
    assert (r.City, r.Category, r.Customer_Name, r.Product, r.Quantity) == ("Pune", "Education", 'N "x", y', 'Monitor 24", black', "2")


def test_malformed_rows_are_quarantined(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEADER + "1,E,Pune,A,2025-01-01,C,N,30,Male,P,2,5.00,10.00\n2,E,Pune\n3,E,Pune,A,2025-01-01,C,N,30,Male,P,2,5.00,10.00,more\n")
    c = coerce(read_sales_csv(spark, str(path)))
    assert valid_rows(c).count() == 1
    assert [r.Reason for r in quarantined_rows(c).collect()] == ["malformed", "malformed"]


def test_a_missing_column_and_a_differing_header_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER.replace("City,", "Town,"))
    with pytest.raises(ValueError, match="City"):
        read_sales_csv(spark, str(tmp_path / "a.csv"))
    d = tmp_path / "two"
    d.mkdir()
    line = "1,E,Pune,A,2025-01-01,C,N,30,Male,P,2,5.00,10.00\n"
    (d / "a.csv").write_text(HEADER + line)
    (d / "b.csv").write_text(HEADER.replace("Category,City", "City,Category") + line)
    with pytest.raises(Exception, match="header|Header"):
        read_sales_csv(spark, str(d)).collect()


def test_line_breaks_in_fields(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(HEADER + '1,E,Pune,A,2025-01-01,C,"two\nlines",30,Male,P,2,5.00,10.00\n')
    rows = read_sales_csv(spark, str(path), multi_line=True).collect()
    assert [r.Customer_Name for r in rows] == ["two\nlines"]


def test_written_files_read_back(spark, sales, tmp_path):
    df = sales(row(Order_ID="A", Product=' a "b", c '), row(Order_ID="B", City=None, Product="back\\slash"))
    write_sales_csv(df, str(tmp_path / "out"))
    back = valid_rows(coerce(read_sales_csv(spark, str(tmp_path / "out"))))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
