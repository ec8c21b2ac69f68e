"""Hypothesis tests on grouped counts, for one segment or for many at once.

Counting runs over all rows on the cluster; the closed forms are columns over the grouped rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.exact import fixed_sum, ratio
from tillscope.functions.special import chi_square_tail, normal_tail
from tillscope.operators.etl import PeakSegment, peak_totals
from tillscope.operators.totals import with_totals
from tillscope.star import Star

Z_95 = 1.959963984540054
ALPHA = 0.05
TOTAL = "Total"


def peak_counts(star: Star, w: PeakSegment = PeakSegment()) -> DataFrame:
    """Failures and rows of the peak segment (x1, n1) and of all other non-fraud rows (x2, n2)."""
    return peak_totals(star, w).select(
        F.lit("peak").alias("segment"),
        F.col("peak_x").alias("x1"),
        F.col("peak_n").alias("n1"),
        (F.col("non_fraud_x") - F.col("peak_x")).alias("x2"),
        (F.col("non_fraud_n") - F.col("peak_n")).alias("n2"),
    )


def segment_counts(df: DataFrame, segment: Sequence[str], event: Column) -> DataFrame:
    """Per segment: events and rows inside (x1, n1) and outside of it (x2, n2)."""
    inside = df.groupBy(*segment).agg(F.count_if(event).alias("x1"), F.count("*").alias("n1"))
    totals = inside.agg(F.sum("x1").alias("_x"), F.sum("n1").alias("_n"))
    return with_totals(inside, totals).select(
        *segment, "x1", "n1", (F.col("_x") - F.col("x1")).alias("x2"), (F.col("_n") - F.col("n1")).alias("n2")
    )


def _div(a: Column | float, b: Column) -> Column:
    return F.try_divide(F.lit(a), b)


def two_proportion_z(counts: DataFrame) -> DataFrame:
    """Rates, pooled rate, pooled standard error and z; NULL where a side has no rows or nothing varies."""
    x1, n1, x2, n2 = (F.col(c).cast("double") for c in ("x1", "n1", "x2", "n2"))
    pool = F.col("p_pool")
    return (
        counts.withColumns({"p1": ratio(x1, n1), "p2": ratio(x2, n2), "p_pool": _div(x1 + x2, n1 + n2)})
        .withColumn("se_pool", F.sqrt(pool * (1.0 - pool) * (_div(1.0, n1) + _div(1.0, n2))))
        .withColumn("z", _div(F.col("p1") - F.col("p2"), F.col("se_pool")))
    )


def z_p_values(tested: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One- and two-tailed p-values and the one-tailed decision."""
    return tested.withColumns(
        {"p_one_tailed": normal_tail(F.col("z")), "p_two_tailed": normal_tail(F.abs("z")) * 2.0}
    ).withColumn("decision", _decision(F.col("p_one_tailed"), alpha))


def _decision(p: Column, alpha: float) -> Column:
    return F.when(p < alpha, "REJECT H0").when(p >= alpha, "FAIL TO REJECT H0")


def effect_sizes(tested: DataFrame) -> DataFrame:
    """Risk increase in points, risk ratio, odds ratio and number needed to harm."""
    p1, p2 = F.col("p1"), F.col("p2")
    return tested.withColumns(
        {
            "abs_risk_increase": (p1 - p2) * 100.0,
            "relative_risk": _div(p1, p2),
            "odds_ratio": _div(_div(p1, 1.0 - p1), _div(p2, 1.0 - p2)),
            "number_needed_to_harm": _div(1.0, p1 - p2),
        }
    )


def diff_confidence_interval(tested: DataFrame, z: float = Z_95) -> DataFrame:
    """Interval of the difference in percentage points, with the unpooled standard error."""
    p1, p2 = F.col("p1"), F.col("p2")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    se = F.sqrt(_div(p1 * (1.0 - p1), n1) + _div(p2 * (1.0 - p2), n2))
    return (
        tested.withColumn("se_unpooled", se)
        .withColumn("ci_lower", ((p1 - p2) - (F.lit(z) * F.col("se_unpooled"))) * 100.0)
        .withColumn("ci_upper", ((p1 - p2) + (F.lit(z) * F.col("se_unpooled"))) * 100.0)
    )


def two_sample(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return z_p_values(diff_confidence_interval(effect_sizes(two_proportion_z(counts))), alpha)


def method_outcomes(star: Star) -> DataFrame:
    """Rows per payment method name and outcome: the status, and FAILED or NON_FAILED."""
    by_id = star.fact.groupBy("payment_method_id", "transaction_status").agg(F.count("*").alias("n"))
    return by_id.join(
        star.methods.select("payment_method_id", "payment_method_name"), "payment_method_id"
    ).select(
        "payment_method_name",
        "transaction_status",
        F.when(F.col("transaction_status") == "FAILED", "FAILED").otherwise("NON_FAILED").alias("is_failed"),
        "n",
    )


def crosstab(
    df: DataFrame,
    row: str,
    col: str,
    values: Sequence[str],
    count: str | None = None,
    by: Sequence[str] = (),
    margins: bool = False,
) -> DataFrame:
    """Counts per row label with one column per listed value, 0 where there are none.

    ``count`` names a column of rows already counted; ``by`` makes one table per group; ``margins`` adds a row
    and a column of totals.
    """
    weight = F.sum(count) if count else F.count("*")
    cells = df.where(F.col(row).isNotNull() & F.col(col).isin(*values)).groupBy(*by, row, col).agg(weight.alias("n"))
    columns = list(values)
    if margins:
        cubed = cells.cube(*by, row, col).agg(
            F.sum("n").alias("n"),
            *[F.grouping(c).alias(f"_{c}") for c in (*by, row, col)],
        )
        for c in by:
            cubed = cubed.where(F.col(f"_{c}") == 0)
        cells = cubed.select(
            *by,
            *[F.when(F.col(f"_{c}") == 1, TOTAL).otherwise(F.col(c)).alias(c) for c in (row, col)],
            "n",
        )
        columns.append(TOTAL)
    wide = cells.groupBy(*by, row).pivot(col, columns).agg(F.sum("n"))
    return wide.na.fill(0, columns)


def _sum_of(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def _with_margins(table: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    columns = [F.col(v) for v in values]
    totals = table.groupBy(*by).agg(
        *[F.sum(c).alias(f"_col_{v}") for v, c in zip(values, columns)], F.sum(_sum_of(columns)).alias("_n")
    )
    return with_totals(table, totals, by).withColumn("_row", _sum_of(columns))


def _expected(value: str) -> Column:
    return ratio(F.col("_row").cast("double") * F.col(f"_col_{value}").cast("double"), F.col("_n"))


def expected_frequencies(table: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each cell of a crosstab as row total x column total / n, to two decimals."""
    full = _with_margins(table, values, by)
    keys = [c for c in table.columns if c not in values]

    def shown(v: str) -> Column:
        return (F.floor(_expected(v) * 100.0 + 0.5).cast("double") / 100.0).alias(f"expected_{v.lower()}")

    return full.select(*keys, *[shown(v) for v in values])


def chi_square(table: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Statistic and degrees of freedom of the test of independence, without continuity correction.

    Empty rows and columns carry no information and do not count.
    """
    full = _with_margins(table, values, by)
    gaps = [F.col(v).cast("double") - _expected(v) for v in values]
    parts = [F.coalesce(F.try_divide(g * g, _expected(v)), F.lit(0.0)) for g, v in zip(gaps, values)]
    filled = [F.when(F.col(f"_col_{v}") > 0, 1).otherwise(0) for v in values]
    return (
        full.where(F.col("_row") > 0)
        .groupBy(*by)
        .agg(
            fixed_sum(_sum_of(parts)).alias("chi2"),
            F.count("*").alias("_rows"),
            F.max(_sum_of(filled)).alias("_cols"),
            F.max("_n").alias("n"),
        )
        .select(
            *by,
            "n",
            "chi2",
            ((F.col("_rows") - 1) * (F.col("_cols") - 1)).cast("int").alias("dof"),
        )
    )


def chi_square_p_value(tested: DataFrame, method: str = "exact", alpha: float = ALPHA) -> DataFrame:
    return tested.withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("dof"), method)).withColumn(
        "decision", _decision(F.col("p_value"), alpha)
    )
