from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillscope.functions import exact


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**17), st.integers(1, 10**17)), min_size=1, max_size=20))
def test_pct_is_half_up_on_exact_numbers(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", exact.pct(F.col("a"), F.col("b")).alias("p"))
    for a, b, p in df.collect():
        wide = Decimal(a) * 100 / Decimal(b)
        if abs(wide) < 10**15:
            # Cut to whole hundredths in integers, where Decimal's own division would round first.
            assert p == Decimal((20000 * a + b) // (2 * b)) / 100
            assert abs(p - wide) <= Decimal("0.005000001")


def test_pct_ties_and_zero(spark):
    row = one(
        spark,
        exact.pct(F.lit(1), F.lit(0)).alias("none"),
        exact.pct(F.lit(-1), F.lit(800)).alias("neg"),
        exact.pct(F.lit(1), F.lit(800)).alias("tie"),
        exact.safe_div(F.lit(1), F.lit(0)).alias("zero"),
    )
    assert (row.none, row.neg, row.tie, row.zero) == (None, Decimal("-0.13"), Decimal("0.13"), 0.0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-(10**11), 10**11), min_size=1, max_size=20))
def test_average_money(spark, cents):
    df = spark.createDataFrame([(c,) for c in cents], "c bigint")
    got = df.agg(exact.avg_money(F.sum("c"), F.count("*")).alias("a")).first().a
    exactly = (Decimal(sum(cents)) / len(cents)).quantize(Decimal(1), ROUND_HALF_UP) / 100
    assert got == exactly


def test_draw_splits_the_digest(spark):
    import hashlib

    digest = hashlib.md5(b"customer:42").hexdigest()
    key = exact.key_digest(F.lit(42), "customer")
    row = one(spark, *[exact.draw(key, i).alias(f"d{i}") for i in range(4)])
    assert list(row) == [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def test_weighted_choice_shares(spark):
    drawn = exact.draw(exact.key_digest(F.col("id"), "x"))
    chosen = exact.weighted_choice(drawn, ["a", "b", "c"], ["0.5", "0.3", "0.2"])
    shares = {r.c: r["count"] for r in spark.range(20000).groupBy(chosen.alias("c")).count().collect()}
    assert shares["a"] / 20000 == pytest.approx(0.5, abs=0.02)
    assert shares["c"] / 20000 == pytest.approx(0.2, abs=0.02)


def test_fixed_sum_does_not_depend_on_order(spark):
    df = spark.range(1000).select((F.col("id") * 0.1 + 1e6).alias("v"))
    sums = {df.repartition(n).agg(exact.fixed_sum(F.col("v")).alias("s")).first().s for n in (1, 3, 7)}
    assert len(sums) == 1
