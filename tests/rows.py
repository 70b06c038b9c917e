"""Rows that tests of several modules build; no conftest, whose name another folder may shadow."""

from datetime import date
from decimal import Decimal

from bazaar.schema import COLUMNS


def row(**kw):
    """A sales row with defaults for everything not given."""
    base = dict(Order_ID="O1", Order_Date=date(2025, 1, 10), Customer_ID="C1", Customer_Name="N",
                Age=30, Gender="Male", City="Patna", Product="Laptop", Category="Electronics",
                Quantity=1, Unit_Price=Decimal("10.00"), Total_Sales=Decimal("10.00"))
    base.update(kw)
    for k in ("Unit_Price", "Total_Sales"):
        if isinstance(base[k], (int, float, str)):
            base[k] = Decimal(str(base[k]))
    return tuple(base[c] for c in COLUMNS)
