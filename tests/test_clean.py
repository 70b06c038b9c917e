"""Coercion and quarantine on dirty text rows (FIXTURES §3)."""

from datetime import date
from decimal import Decimal

from bazaar.operators.clean import coerce, quarantined_rows, valid_rows

GOOD = dict(Order_ID="A1", Order_Date="2025-01-01", Customer_ID="C", Customer_Name="N", Age="30",
            Gender="Male", City="Pune", Product="Book", Category="Education", Quantity="2",
            Unit_Price="5.00", Total_Sales="10.00")


def one(raw, **kw):
    d = dict(GOOD, **kw)
    return coerce(raw(d)).collect()[0]


def test_whole_numbers_and_null_tokens(raw):
    assert one(raw, Age="30.0").Age == 30
    assert one(raw, Quantity="30.0").Quantity == 30
    for bad in ["abc", "", "nan", "NA", "7d", "inf", "1,000"]:
        r = one(raw, Age=bad)
        assert r.Age is None and r.Reason is None, bad


def test_fractional_age_is_quarantined(raw):
    r = one(raw, Age="29.5")
    assert r.Reason == "fractional_age" and r.raw_Age == "29.5"


def test_money(raw):
    assert one(raw, Total_Sales="10.555").Total_Sales == Decimal("10.56")
    assert one(raw, Total_Sales="1e3").Total_Sales == Decimal("1000.00")
    assert one(raw, Total_Sales="1,000").Total_Sales is None


def test_dates(raw):
    for bad in ["2025-02-30", "bad", "", "05/01/2025"]:
        assert one(raw, Order_Date=bad).Order_Date is None, bad
    assert one(raw, Order_Date="2025-03-04").Order_Date == date(2025, 3, 4)


def test_order_id_rules(raw):
    assert one(raw, Order_ID="").Reason == "order_id_null"
    assert one(raw, Order_ID="x" * 21).Reason == "order_id_length"
    assert one(raw, Order_ID="x" * 20).Reason is None


def test_city_null_tokens(raw):
    assert one(raw, City="N/A").City is None
    assert one(raw, City="null").City is None


def test_split_is_complete(raw):
    rows = [dict(GOOD, Order_ID=str(i)) for i in range(5)] + [dict(GOOD, Order_ID=""), dict(GOOD, Age="1.5")]
    c = coerce(raw(*rows))
    assert valid_rows(c).count() == 5
    q = quarantined_rows(c).collect()
    assert sorted(r.Reason for r in q) == ["fractional_age", "order_id_null"]
    assert valid_rows(c).count() + len(q) == len(rows)


def test_more_number_shapes(raw):
    assert one(raw, Quantity="+5").Quantity == 5
    assert one(raw, Quantity=" 7 ").Quantity == 7
    assert one(raw, Total_Sales=".5").Total_Sales == Decimal("0.50")
    assert one(raw, Total_Sales="-2.345").Total_Sales == Decimal("-2.35")
    assert one(raw, Total_Sales="2.5E2").Total_Sales == Decimal("250.00")
    assert one(raw, Age="1e12").Age is None  # beyond INT
    assert one(raw, Quantity="2.5").Reason == "fractional_quantity"


def test_text_rules(raw):
    assert one(raw, City="  Pune ").City == "  Pune "
    assert one(raw, City="x" * 51).Reason == "text_length"
    assert one(raw, Product="p" * 100).Reason is None


def test_other_date_formats(raw):
    assert one(raw, Order_Date="2025-03-04 10:11:12").Order_Date == date(2025, 3, 4)
    assert one(raw, Order_Date="2025/03/04").Order_Date == date(2025, 3, 4)


def test_numbers_beyond_the_column_are_quarantined(raw):
    assert one(raw, Age="99999999999").Reason == one(raw, Quantity="-2147483648").Reason == "integer_overflow"
    assert one(raw, Total_Sales="1234567890123456.00").Reason == "money_overflow"
    assert one(raw, Unit_Price="12345678901.00").Reason == "money_overflow"


def test_kept_text_is_not_trimmed(raw):
    assert one(raw, City=" Pune").City == " Pune"
    assert one(raw, City=" NA ").City is None
    assert one(raw, Age=" 30 ").Age == 30


def test_date_formats_are_a_parameter(raw):
    c = coerce(raw(dict(GOOD, Order_Date="15-Jan-2025")), ["dd-MMM-yyyy"]).first()
    assert c.Order_Date == date(2025, 1, 15)


def test_report_rows_keep_every_row(raw):
    from bazaar.operators.clean import report_rows
    rows = [dict(GOOD, Age="29.5"), dict(GOOD, Order_ID=""), dict(GOOD, City="x" * 60), dict(GOOD, Quantity="2.25", Age="x")]
    got = report_rows(raw(*rows)).collect()
    assert len(got) == 4 and got[0].Age == Decimal("29.5") and got[1].Order_ID is None
    assert got[2].City == "x" * 60 and got[3].Quantity == Decimal("2.25") and got[3].Age is None


def test_date_format_does_not_depend_on_row_order(raw):
    from bazaar.operators.clean import best_format, format_counts, report_rows, with_one_date_format
    formats = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"]
    texts = ["03/04/2025", "05/06/2025", "25/12/2024", "31/02/2025", "soon", None]
    for order in (texts, texts[::-1], [texts[2], *texts[:2], *texts[3:]]):
        df = raw(*[dict(Order_ID=str(i), Order_Date=t) for i, t in enumerate(order)])
        assert [r.Parsed for r in format_counts(df, formats).orderBy("Position").collect()] == [0, 2, 3]
        assert df.select(best_format(df, formats)).first()[0] == "dd/MM/yyyy"
        got = {order[int(r.Order_ID)]: r.Order_Date and str(r.Order_Date) for r in report_rows(with_one_date_format(df, formats)).collect()}
        assert got == {"03/04/2025": "2025-04-03", "05/06/2025": "2025-06-05", "25/12/2024": "2024-12-25", "31/02/2025": None, "soon": None, None: None}
    tied = raw(dict(Order_ID="1", Order_Date="03/04/2025"))
    assert tied.select(best_format(tied, formats)).first()[0] == "MM/dd/yyyy"


def test_report_rows_keep_large_numbers(raw):
    from bazaar.operators.clean import report_rows
    from bazaar.operators.profile import describe_numeric
    from bazaar.operators.reports import total_revenue
    df = report_rows(raw(dict(Order_ID="A", Total_Sales="1234567890123456.00", Unit_Price="12345678901.50", Age="999999999999999", Quantity="1"),
                         dict(Order_ID="B", Total_Sales="0.50", Unit_Price="1.00", Age="20", Quantity="123456789012.5")))
    row = df.orderBy("Order_ID").first()
    assert (str(row.Total_Sales), str(row.Unit_Price), int(row.Age)) == ("1234567890123456.00", "12345678901.50", 999999999999999)
    assert total_revenue(df).first().Total_Revenue_INR == 1234567890123456.5
    assert {r.Column: r.Max for r in describe_numeric(df).collect()}["Total_Sales"] == 1234567890123456.0
