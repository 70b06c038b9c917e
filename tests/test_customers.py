"""Distinct customers from bitmaps."""

import random

from bazaar.operators import customers
from rows import row


def test_bitmaps_count_like_sets_and_merge(sales):
    random.seed(2)
    made = [dict(City=random.choice(["Pune", "Gaya", None]), Category=random.choice("ab"), Customer_ID=random.choice([None, *(f"C{i}" for i in range(40))]))
            for _ in range(500)]
    df = sales(*[row(**m) for m in made])
    numbers = customers.numbering(df)
    whole = customers.present_customers(customers.bitmaps(df, numbers, ["City", "Category"])).collect()
    got = {(r.Dimension, r.Key): (r.Total_Orders, r.Unique_Customers) for r in whole}
    for d in ("City", "Category"):
        for key in {m[d] for m in made}:
            mine = [m["Customer_ID"] for m in made if m[d] == key]
            assert got[d, key] == (len(mine), len(set(mine) - {None}))
    assert got["All", None] == (500, 40) and len(got) == 6
    parts = [customers.bitmaps(df.where(f"City {test}"), numbers, ["City", "Category"]) for test in ("= 'Pune'", "is distinct from 'Pune'")]
    assert sorted(map(str, customers.present_customers(customers.merged(parts)).collect())) == sorted(map(str, whole))


def test_more_customers_than_a_bucket(spark):
    df = spark.range(100_000).selectExpr("cast(id % 70000 AS string) AS Customer_ID", "'x' AS City", "cast(1 AS decimal(14,2)) AS Total_Sales")
    table = customers.bitmaps(df, customers.numbering(df), ["City"])
    assert {r.Dimension: r.Unique_Customers for r in customers.present_customers(table).collect()} == {"City": 70000, "All": 70000}
    assert table.count() == 6  # three buckets for the city and three for all
