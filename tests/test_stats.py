"""Published results of both tests."""

import math

import pytest
from pyspark.sql import functions as F
from tiny import customer, tiny_star, txn

from tillscope.functions.special import chi_square_tail
from tillscope.operators import stats

OBSERVED = [
    ("Credit/Debit Card", 17419, 2462, 129884),
    ("Digital Wallet", 5409, 710, 39057),
    ("Net Banking Transfer", 3568, 478, 26018),
    ("UPI Instant Pay", 8836, 1221, 65051),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    rows = []
    for name, failed, fraud, ok in OBSERVED:
        rows += [(name, "FAILED", "FAILED", failed)]
        rows += [(name, "FRAUD_BLOCKED", "NON_FAILED", fraud), (name, "SUCCESS", "NON_FAILED", ok)]
    return spark.createDataFrame(rows, "method string, status string, failed string, n bigint")


def test_two_proportions(spark):
    counts = spark.createDataFrame([("peak", 57, 184, 35175, 295058)], "segment string, x1 long, n1 long, x2 long, n2 long")
    r = stats.two_sample(counts).first()
    assert round(r.z, 4) == 7.9715
    assert r.p_one_tailed == pytest.approx(7.838391e-16, rel=1e-6)
    assert r.p_two_tailed == pytest.approx(1.567678e-15, rel=1e-6)
    assert round(r.abs_risk_increase, 2) == 19.06 and round(r.relative_risk, 2) == 2.60
    assert round(r.odds_ratio, 2) == 3.32 and round(r.number_needed_to_harm, 1) == 5.2
    assert (round(r.ci_lower, 2), round(r.ci_upper, 2)) == (12.37, 25.74)
    assert r.decision == "REJECT H0"


def test_empty_side_gives_null(spark):
    counts = spark.createDataFrame([("none", 0, 0, 5, 10)], "segment string, x1 long, n1 long, x2 long, n2 long")
    r = stats.two_sample(counts).first()
    assert r.z is None and r.p_one_tailed is None and r.decision is None


def test_failed_by_method(outcomes):
    values = ("FAILED", "NON_FAILED")
    table = stats.crosstab(outcomes, "method", "failed", values, "n")
    r = stats.chi_square(table, values).first()
    assert (round(r.chi2, 4), r.dof, r.n) == (4.6099, 3, 300113)
    tested = stats.chi_square(table, values)
    published = stats.chi_square_p_value(tested, "wilson_hilferty").first()
    assert published.p_value == pytest.approx(2.010596e-01, rel=1e-5)
    exact = stats.chi_square_p_value(tested).first()
    assert round(exact.p_value, 6) == 0.202695 and exact.decision == "FAIL TO REJECT H0"
    expected = {r.method: r.expected_failed for r in stats.expected_frequencies(table, values).collect()}
    assert expected == {
        "Credit/Debit Card": 17581.78,
        "Digital Wallet": 5303.47,
        "Net Banking Transfer": 3529.39,
        "UPI Instant Pay": 8817.36,
    }


def test_status_by_method(outcomes):
    values = ("FAILED", "FRAUD_BLOCKED", "SUCCESS")
    table = stats.crosstab(outcomes, "method", "status", values, "n")
    r = stats.chi_square_p_value(stats.chi_square(table, values)).first()
    assert (round(r.chi2, 4), r.dof, round(r.p_value, 4)) == (5.7567, 6, 0.4510)


def test_margins(outcomes):
    table = stats.crosstab(outcomes, "method", "failed", ("FAILED", "NON_FAILED"), "n", margins=True)
    rows = {r.method: (r.FAILED, r.NON_FAILED, r.Total) for r in table.collect()}
    assert rows["Total"] == (35232, 264881, 300113)
    assert rows["UPI Instant Pay"] == (8836, 66272, 75108)


def test_empty_rows_and_columns_do_not_count(spark):
    df = spark.createDataFrame([("a", "x", 5), ("a", "y", 7), ("b", "x", 9), ("b", "y", 2)], "r string, c string, n long")
    plain = stats.chi_square(stats.crosstab(df, "r", "c", ("x", "y"), "n"), ("x", "y")).first()
    padded = stats.chi_square(stats.crosstab(df, "r", "c", ("x", "y", "z"), "n"), ("x", "y", "z")).first()
    assert (plain.chi2, plain.dof) == (padded.chi2, padded.dof) == (plain.chi2, 1)


def test_tests_per_group(spark):
    rows = [(g, r, c, n) for g in "pq" for r, c, n in (("a", "x", 5), ("a", "y", 7), ("b", "x", 9), ("b", "y", 2))]
    df = spark.createDataFrame(rows, "g string, r string, c string, n long")
    table = stats.crosstab(df, "r", "c", ("x", "y"), "n", by=["g"])
    out = stats.chi_square(table, ("x", "y"), ["g"]).collect()
    assert len(out) == 2 and out[0].chi2 == out[1].chi2 > 0


@pytest.mark.parametrize("x,k,p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (11.070497693516351, 5, 0.05), (0.0, 3, 1.0), (5000.0, 7, 0.0)])
def test_chi_square_tail(spark, x, k, p):
    got = spark.range(1).select(chi_square_tail(F.lit(x), F.lit(k)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-9)


def test_peak_counts_leave_unknown_customers_in_the_rest(spark):
    from datetime import datetime

    peak = {"transaction_timestamp": datetime(2023, 7, 1, 18, 0)}
    rows = [txn(1, customer=1, status="FAILED", **peak), txn(2, customer=1, **peak), txn(3, customer=7, **peak)]
    rows += [txn(4, customer=1, status="FRAUD_BLOCKED", **peak), txn(5, customer=1, status="FAILED")]
    r = stats.peak_counts(tiny_star(spark, rows, [customer(1, "Tier-2 Cities")])).first()
    assert (r.x1, r.n1, r.x2, r.n2) == (1, 2, 1, 2)
    assert not math.isnan(r.x1)


def test_chi_square_of_large_counts(spark):
    from tillscope.operators import stats as s

    rows = spark.createDataFrame([("a", 400_000_000_000, 600_000_000_000), ("b", 600_000_000_000, 400_000_000_000)], "r string, x long, y long")
    assert s.chi_square(rows, ["x", "y"]).first().chi2 == pytest.approx(8e10, rel=1e-12)


def test_small_probabilities_keep_their_digits(spark):
    from pyspark.sql import functions as F

    from tillscope.functions.exact import round4, significant

    got = spark.range(1).select(
        significant(F.lit(7.838391234e-16)).alias("p"), significant(F.lit(None).cast("double")).alias("none"), round4(F.lit(1.5e17)).alias("big")
    ).first()
    assert (got.p, got.none, got.big) == (7.83839e-16, None, 1.5e17)
