"""Exact ratio rounding equals Python's Decimal arithmetic, for both tie rules and all signs."""

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, localcontext

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaar.functions.money import round_ratio

pairs = st.lists(st.tuples(st.integers(-10**15, 10**15), st.integers(-10**6, 10**6).filter(lambda d: d != 0)),
                 min_size=1, max_size=200)


def expected(num_cents, den, scale, factor, rounding):
    with localcontext() as ctx:
        ctx.prec = 80
        q = Decimal(factor) * Decimal(num_cents) / Decimal(100) / Decimal(den)
        return float(q.quantize(Decimal(1).scaleb(-scale), rounding=rounding))


@settings(max_examples=6, deadline=None)
@given(pairs, st.sampled_from([0, 1, 2, 6]), st.sampled_from([1, 100]), st.booleans())
def test_round_ratio_is_exact(spark, rows, scale, factor, half_even):
    df = spark.createDataFrame([(Decimal(n).scaleb(-2), d) for n, d in rows], "num decimal(20,2), den bigint")
    got = df.select(round_ratio(F.col("num"), F.col("den"), scale=scale, factor=factor,
                                half_even=half_even).alias("r")).collect()
    mode = ROUND_HALF_EVEN if half_even else ROUND_HALF_UP
    assert [r.r for r in got] == [expected(n, d, scale, factor, mode) for n, d in rows]


def test_no_overflow_past_bigint(spark):
    # A 100 TB revenue total in 1/100ths of a rupee exceeds 2^63.
    df = spark.createDataFrame([(Decimal("123456789012345678.91"), 1)], "num decimal(24,2), den bigint")
    got = df.select(round_ratio("num", "den", scale=2).alias("r")).first().r
    assert got == 123456789012345678.91


def test_integral_inputs_do_not_overflow(spark):
    df = spark.createDataFrame([(10 ** 15, 3), (2 ** 40, 2 ** 20)], "num bigint, den bigint")
    got = [r[0] for r in df.select(round_ratio("num", "den", scale=2)).collect()]
    assert got == [333333333333333.33, 1048576.0]


def test_ties(spark):
    df = spark.createDataFrame([(Decimal("0.25"), 1), (Decimal("0.35"), 1), (Decimal("-0.25"), 1), (Decimal("1"), 0)],
                               "num decimal(20,2), den bigint")
    up = [r[0] for r in df.select(round_ratio("num", "den", scale=1)).collect()]
    even = [r[0] for r in df.select(round_ratio("num", "den", scale=1, half_even=True)).collect()]
    assert up == [0.3, 0.4, -0.3, None]
    assert even == [0.2, 0.4, -0.2, None]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(-10**14, 10**14), st.integers(1, 10**9)), min_size=1, max_size=200))
def test_labels_equal_python_formatting(spark, rows):
    from bazaar.functions import fmt
    df = spark.createDataFrame([(Decimal(a).scaleb(-2), Decimal(b).scaleb(-2)) for a, b in rows],
                               "a decimal(20,2), b decimal(20,2)")
    got = df.select(fmt.rupees(F.col("a")).alias("r0"), fmt.rupees(F.col("a"), 2).alias("r2"),
                    fmt.millions(F.col("a")).alias("m"), fmt.percent(F.col("a"), F.col("b")).alias("p")).collect()
    with localcontext() as ctx:
        ctx.prec = 80
        for (a, b), g in zip(rows, got):
            x, y = Decimal(a).scaleb(-2), Decimal(b).scaleb(-2)
            assert g.r0 == "Rs.{:,.0f}".format(x)
            assert g.r2 == "Rs.{:,.2f}".format(x)
            assert g.m == "Rs.{:.1f}M".format(x / Decimal(10 ** 6))
            assert g.p == "{:.1f}%".format(x * 100 / y)
