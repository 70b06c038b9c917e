"""The command line drives load, eda and report end to end."""

from bazaar.__main__ import main
from bazaar.sources.csv import write_sales_csv
from rows import row


def test_load_eda_report(spark, sales, tmp_path, capsys):
    csv = str(tmp_path / "orders.csv")
    write_sales_csv(sales(row(Order_ID="A"), row(Order_ID="B", City="Gaya")), csv)
    assert main(["load", "--csv", csv, "--db", "cli_test"], spark) == 0
    assert "true" in capsys.readouterr().out
    ids = spark.table("cli_test.sales_rows").select("id").collect()
    assert sorted(r.id for r in ids) == [1, 2]
    assert main(["report", "revenue_by_city", "--db", "cli_test"], spark) == 0
    assert "Gaya" in capsys.readouterr().out
    assert main(["report", "revenue_by_city", "--csv", csv], spark) == 0
    assert "Gaya" in capsys.readouterr().out
    out = str(tmp_path / "eda")
    assert main(["eda", "--db", "cli_test", "--out", out, "--generated-at", "2026-01-01T10:00"], spark) == 0
    assert spark.read.parquet(out + "/kpi_summary").first().Total_Orders == 2
    assert main(["eda", "--csv", csv, "--out", out + "2"], spark) == 0
    assert spark.read.parquet(out + "2/kpi_summary").first().Total_Orders == 2


def test_database_target_failure_is_reported(spark, sales, tmp_path):
    import pytest
    csv = str(tmp_path / "orders.csv")
    write_sales_csv(sales(row(Order_ID="A")), csv)
    with pytest.raises(Exception):
        main(["load", "--csv", csv, "--db", "cli_jdbc", "--to-jdbc-url", "jdbc:unreachable://localhost/x"], spark)
    assert spark.table("cli_jdbc.sales_data").count() == 1  # the catalog load itself completed


def test_report_on_star_schema_tables(spark, capsys):
    assert main(["report", "revenue_by_category", "--tables", "/root/testdata/sf0.001"], spark) == 0
    assert "Revenue_Share_Pct" in capsys.readouterr().out


def test_reports_on_a_file_keep_every_row(spark, tmp_path, capsys):
    path = tmp_path / "dirty.csv"
    path.write_text("id,Total_Sales,Order_ID,Order_Date,Customer_ID,Customer_Name,Age,Gender,City,Product,Category,Quantity,Unit_Price\n"
                    "1,10.00,A,2025-01-05,C,N,29.5,Male,Pune,\"Monitor 24\"\", black\",X,2,5.00\n"
                    "2,10.00,,15-Jan-2025,C,N,30,Male, Pune,P,X,2,5.00\n")
    assert main(["report", "total_revenue", "--csv", str(path)], spark) == 0
    out = capsys.readouterr().out
    assert "20.0" in out and "2" in out
    assert main(["report", "monthly_revenue", "--csv", str(path), "--date-format", "dd-MMM-yyyy", "--date-format", "yyyy-MM-dd"], spark) == 0
    out = capsys.readouterr().out
    assert out.count("Jan 2025") == 1 and "20.0" in out  # both dates are read


def test_another_process_finds_the_loaded_table(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    csv = tmp_path / "orders.csv"
    csv.write_text("Order_ID,Order_Date,Customer_ID,Customer_Name,Age,Gender,City,Product,Category,Quantity,Unit_Price,Total_Sales\n"
                   "A,2025-01-05,C,N,29,Male,Pune,P,X,2,5.00,10.00\nB,2025-01-06,C,N,29.5,Male,Pune,P,X,2,5.00,10.00\n")
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1])}

    def run(*args):
        done = subprocess.run([sys.executable, "-m", "bazaar", "--master", "local[1]", *args], env=env, cwd=tmp_path,
                              capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        return done.stdout

    where = ["--db", "two_runs", "--warehouse", str(tmp_path / "warehouse")]
    assert "|2          |1          |1               |true" in run("load", "--csv", str(csv), *where)
    assert "|10.0" in run("report", "total_revenue", *where)
