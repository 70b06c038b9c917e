"""Report lines reproduce the published table layout; padding never truncates."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from bazaar.functions import fmt
from bazaar.plans import eda_job, report
from rows import row

GOLDEN = [("Laptop", "Electronics", 25443009), ("Mobile", "Electronics", 25335573),
          ("Book", "Education", 25031689), ("Rice", "Grocery", 22231711),
          ("Chair", "Furniture", 21521561), ("Shoes", "Fashion", 19835896)]


def test_padding_does_not_truncate(spark):
    r = spark.range(1).select(fmt.pad_right(F.lit("Electronics"), 10).alias("a"),
                              fmt.pad_left(F.lit("7"), 3).alias("b")).first()
    assert (r.a, r.b) == ("Electronics", "  7")


def test_report_lines_match_published_layout(sales, tmp_path):
    df = sales(*[row(Product=p, Category=c, City="Patna", Total_Sales=Decimal(v)) for p, c, v in GOLDEN])
    secs = eda_job.sections(df, cache=False)
    lines = [r.Line for r in report.ordered_lines(report.report_lines(secs, datetime(2026, 6, 21, 8, 14))).collect()]
    assert lines[0] == "> **Generated:** 21 June 2026, 08:14"
    assert "| Total Records         | 6                                             |" in lines
    assert "| Total Revenue         | Rs.139,399,439.00                             |" in lines
    assert "- **Top Category:** Electronics (Rs.50.78M — 36.4% of revenue)" in lines
    assert "- **Best Sales Month:** January" in lines and "- **Electronics:** 36.4% of revenue" in lines
    assert lines.index("- **Electronics:** 36.4% of revenue") < lines.index("| Category   | Revenue (Rs.)      | Share (%) |")
    assert "| Electronics |         50,778,582 |     36.4 |" in lines
    assert "| Education  |         25,031,689 |     18.0 |" in lines
    assert "| Laptop      |         25,443,009 |" in lines
    report.write_report(secs, str(tmp_path / "report"), datetime(2026, 6, 21, 8, 14))
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.splitlines() == lines


def test_sorted_part_files_keep_order(sales, tmp_path):
    df = sales(*[row(Product=p, Category=c, City="Patna", Total_Sales=Decimal(v)) for p, c, v in GOLDEN])
    secs = eda_job.sections(df, cache=False)
    stamp = datetime(2026, 6, 21, 8, 14)
    report.write_report(secs, str(tmp_path / "one"), stamp, single_file=True)
    report.write_report(secs, str(tmp_path / "many"), stamp)
    read = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*")))
    assert read("one") == read("many")
