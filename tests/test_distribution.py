"""Histogram, density and exact percentiles against brute force."""

import math
import random
from decimal import Decimal

import numpy as np

from bazaar.operators.distribution import density, histogram
from bazaar.operators.profile import describe_numeric
from bazaar.operators.quantiles import exact_percentiles
from rows import row


def test_histogram_edges(sales):
    df = sales(*[row(Age=a) for a in [10, 20, 20, 30]])
    ages = [10, 20, 20, 30]
    counts, _ = np.histogram(ages, bins=20)
    got = [r.Orders for r in histogram(df).orderBy("Bin").collect()]
    assert got == counts.tolist()


def test_histogram_five_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in [10, 20, 20.5, 29.999, 30]], "Age double")
    got = [r.Orders for r in histogram(df, "Age", bins=5).orderBy("Bin").collect()]
    assert got == [1, 0, 2, 0, 2]


def test_histogram_constant(sales):
    got = [r.Orders for r in histogram(sales(row(Age=5), row(Age=5))).orderBy("Bin").collect()]
    assert got[10] == 2 and sum(got) == 2


def test_density_matches_direct_sum(sales):
    ages = [18, 22, 22, 35, 40, 41, 60]
    d = density(sales(*[row(Age=a) for a in ages])).orderBy("Point").collect()
    a = np.array(ages, dtype=float)
    h = a.std(ddof=1) * len(a) ** -0.2
    xs = np.linspace(a.min(), a.max(), 300)
    ref = np.exp(-0.5 * ((xs[:, None] - a[None, :]) / h) ** 2).sum(1) / (len(a) * h * math.sqrt(2 * math.pi))
    assert len(d) == 300
    assert max(abs(r.Density - ref[i]) for i, r in enumerate(d)) < 1e-9


def test_density_of_constant_is_empty(sales):
    assert density(sales(row(Age=5), row(Age=5))).count() == 0
    assert density(sales(row(Age=5))).count() == 0


def test_exact_percentiles_with_hot_value(spark):
    rnd = random.Random(7)
    vals = [rnd.randint(0, 10_000) / 100 for _ in range(3000)] + [42.0] * 1500
    df = spark.createDataFrame([(Decimal(str(v)),) for v in vals], "x decimal(14,2)")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    ref = np.percentile(np.array(vals), [p * 100 for p in probs])
    for options in [dict(), dict(ranges=1), dict(ranges=16)]:
        got = exact_percentiles(df, "x", probs, **options).collect()[0]
        for i, p in enumerate(probs):
            assert abs(float(got[f"p{i}"]) - ref[i]) < 1e-9, (p, options)


def test_describe_matches_pandas(sales):
    ages = [18, 22, 22, 35, 40, 41, 60, None]
    d = describe_numeric(sales(*[row(Age=a) for a in ages]), ["Age"]).collect()[0]
    a = np.array([x for x in ages if x is not None], dtype=float)
    assert d.Count == 7 and abs(d.Mean - a.mean()) < 1e-6 and abs(d.Std - a.std(ddof=1)) < 1e-6
    assert [d.P25, d.P50, d.P75] == list(np.percentile(a, [25, 50, 75]))


def test_grouped_percentiles_edge_groups(spark):
    from bazaar.operators.quantiles import grouped_percentiles
    rnd = random.Random(3)
    groups = {"one": [5.0], "same": [2.5] * 40, "wide": [rnd.randint(-500, 500) / 4 for _ in range(700)]}
    rows = [(k, Decimal(str(v))) for k, vs in groups.items() for v in vs] + [("wide", None)]
    df = spark.createDataFrame(rows, "k string, v decimal(10,2)")
    probs = [0.0, 0.3, 0.5, 0.99, 1.0]
    for options in [dict(), dict(ranges=2), dict(ranges=40)]:
        got = {r.k: r for r in grouped_percentiles(df, "k", "v", probs, **options).collect()}
        for k, vs in groups.items():
            ref = np.percentile(np.array(vs), [p * 100 for p in probs])
            assert [round(float(got[k][f"p{i}"]), 9) for i in range(len(probs))] == [round(x, 9) for x in ref], (k, options)


def test_describe_approximate_is_close(sales):
    ages = list(range(18, 80)) * 3
    df = sales(*[row(Age=a) for a in ages])
    exact = describe_numeric(df, ["Age"]).first()
    approx = describe_numeric(df, ["Age"], exact=False).first()
    assert (approx.Count, approx.Mean, approx.Min, approx.Max) == (exact.Count, exact.Mean, exact.Min, exact.Max)
    assert all(abs(getattr(approx, p) - getattr(exact, p)) <= 1 for p in ("P25", "P50", "P75"))


def test_describe_does_not_depend_on_the_number_of_ranges(spark):
    from bazaar.sources.tables import sales_table
    fact = sales_table(spark, "/root/testdata/sf0.01")
    assert describe_numeric(fact, ranges=2).collect() == describe_numeric(fact, ranges=50).collect()


from hypothesis import Phase, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None, phases=[Phase.generate])
@given(st.lists(st.one_of(st.integers(-50, 150).map(float),
                          st.floats(-1000, 1000, allow_nan=False).map(lambda x: round(x, 3))),
                min_size=1, max_size=80),
       st.sampled_from([1, 5, 20, 37]))
def test_histogram_equals_numpy(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "Age double")
    got = [r.Orders for r in histogram(df, "Age", bins=bins).orderBy("Bin").collect()]
    counts, _ = np.histogram(np.array(values), bins=bins)
    assert got == counts.tolist()


def test_density_of_fractional_values(spark):
    from bazaar.operators.distribution import density
    rnd = random.Random(11)
    vals = [rnd.gauss(40, 9) for _ in range(150)]
    d = density(spark.createDataFrame([(v,) for v in vals], "x double"), "x").orderBy("Point").collect()
    a = np.array(vals)
    h = a.std(ddof=1) * len(a) ** -0.2
    xs = np.linspace(a.min(), a.max(), 300)
    ref = np.exp(-0.5 * ((xs[:, None] - a[None, :]) / h) ** 2).sum(1) / (len(a) * h * math.sqrt(2 * math.pi))
    assert len(d) == 300 and max(abs(r.Density - ref[i]) for i, r in enumerate(d)) < 1e-9


def test_describe_exact_rejects_floating_columns(spark):
    import pytest
    df = spark.createDataFrame([(1.5,)], "x double")
    with pytest.raises(ValueError):
        describe_numeric(df, ["x"])
    assert describe_numeric(df, ["x"], exact=False).first().Count == 1


def test_describe_keeps_all_null_column(sales):
    rows = describe_numeric(sales(row(Age=None), row(Age=None))).collect()
    by = {r.Column: r for r in rows}
    assert [r.Column for r in rows] == ["Age", "Quantity", "Unit_Price", "Total_Sales"]
    assert by["Age"].Count == 0 and by["Age"].Mean is None and by["Age"].P50 is None
    assert by["Quantity"].Count == 2 and by["Quantity"].Std == 0.0


def test_binned_density_is_within_its_bound(spark):
    from bazaar.operators.distribution import binned_density
    rnd = random.Random(5)
    # Two narrow heaps far apart, so that most points are out of reach of all values.
    vals = [round(rnd.gauss(100, 2), 2) for _ in range(900)] + [round(rnd.gauss(5000, 1), 2) for _ in range(700)] + [100.0] * 400
    df = spark.createDataFrame([(Decimal(str(v)),) for v in vals] + [(None,)], "x decimal(14,2)")
    a = np.array(vals)
    h = a.std(ddof=1) * len(a) ** -0.2
    xs = np.linspace(a.min(), a.max(), 300)
    ref = np.exp(-0.5 * ((xs[:, None] - a[None, :]) / h) ** 2).sum(1) / (len(a) * h * math.sqrt(2 * math.pi))
    for cells in (200, 5000, 32768):
        d = binned_density(df, "x", cells=cells).orderBy("Point").collect()
        worst = max(abs(r.Density - y) for r, y in zip(d, ref))
        assert [r.Point for r in d] == list(range(300)) and np.allclose([r.X for r in d], xs)
        assert worst <= d[0].Error_Bound + 1e-15, cells
    assert worst < 1e-9
    assert binned_density(df.limit(0), "x").count() == 0 and binned_density(df.where("x = 100"), "x").count() == 0
