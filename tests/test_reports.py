from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tiny import customer, merchant, tiny_star, txn

from tillscope.operators.prefix import running_total
from tillscope.plans import digests, measures, reports, suite

D = Decimal


def test_anchor_volumes(star):
    row = reports.macro_kpis(star).first()
    assert (row.failed_txn_count, row.revenue_at_risk_inr) == (780, D("2024701.44"))
    assert (row.fraud_blocked_count, row.fraud_blocked_volume_inr) == (128, D("360725.48"))
    assert (row.successful_txn_count, row.successful_volume_inr) == (5092, D("13482782.51"))


def test_empty_star(spark):
    empty = tiny_star(spark, [], [], [])
    row = reports.macro_kpis(empty).first()
    assert row.total_transactions == 0 and row.total_gmv_inr is None and row.fraud_rate_pct is None
    zero = reports.macro_kpis_zero(empty).first()
    assert zero.revenue_at_risk_inr is None
    for name in ("channel_performance", "merchant_pareto", "churn_risk_tiers", "gateway_sla", "peak_hour_anomaly"):
        assert getattr(reports, name)(empty).count() == 0


def test_missing_status_is_null_or_zero_as_the_report_says(spark):
    star = tiny_star(spark, [txn(1)])
    assert reports.macro_kpis(star).first().revenue_at_risk_inr is None
    assert reports.macro_kpis_zero(star).first().revenue_at_risk_inr == 0


def test_null_amount_counts_as_attempt_without_volume(spark):
    star = tiny_star(spark, [txn(1, amount=None), txn(2, amount="50.00")])
    row = reports.macro_kpis(star).first()
    assert (row.total_transactions, row.total_gmv_inr) == (2, D("50.00"))


def test_off_hours_end_at_six(spark):
    at = [datetime(2023, 1, 1, 5, 59, 59), datetime(2023, 1, 1, 6, 0, 0)]
    star = tiny_star(spark, [txn(i, transaction_timestamp=t) for i, t in enumerate(at)])
    rows = {r.time_window: r.total_transactions for r in reports.offhours_fraud(star).collect()}
    assert rows == {reports.OFF_HOURS: 1, reports.DAY_HOURS: 1}


def test_surge_ratio(spark):
    night, day = datetime(2023, 1, 1, 2), datetime(2023, 1, 1, 14)
    big = {"amount": "6000.00"}
    rows = [txn(1, status="FRAUD_BLOCKED", transaction_timestamp=night, **big)]
    rows += [txn(i, transaction_timestamp=night, **big) for i in range(2, 5)]
    rows += [txn(9, status="FRAUD_BLOCKED", transaction_timestamp=day, **big)]
    rows += [txn(i, transaction_timestamp=day, **big) for i in range(10, 17)]
    assert reports.offhours_surge_ratio(tiny_star(spark, rows)).first().surge_ratio == 2.0


def spender(cid, total, failed, n):
    each = D(total) / n
    return [
        txn(cid * 1000 + i, customer=cid, amount=str(each), status="FAILED" if i < failed else "SUCCESS")
        for i in range(n)
    ]


def test_churn_thresholds(spark):
    rows = spender(1, "25000.00", 1, 5) + spender(2, "25000.05", 1, 5) + spender(3, "60000", 3, 10)
    rows += spender(4, "40000", 1, 4) + spender(5, "90000", 1, 10)
    star = tiny_star(spark, rows, [customer(i) for i in range(1, 6)])
    strict = {r.customer_id: r.risk_tier for r in reports.churn_risk_tiers(star).collect()}
    assert strict == {
        2: "Tier 3 - Moderate Churn Risk",
        3: "Tier 1 - Critical Churn Risk",
        4: "Tier 2 - Severe Churn Risk",
    }
    assert {r.customer_id for r in reports.at_risk_customers_having(star).collect()} == {1, 2, 3, 4}


def test_rounded_rate_passes_only_the_rounded_report(spark):
    # 3999 of 20000 is 19.995 percent: 20.00 when rounded, below 20 when not.
    rows = [txn(i, amount="10.00", status="FAILED" if i < 3999 else "SUCCESS") for i in range(20000)]
    star = tiny_star(spark, rows)
    assert reports.churn_risk_tiers(star).count() == 1
    assert reports.at_risk_customers_having(star).count() == 0


def test_pareto_cut(spark):
    losses = {1: "80.00", 2: "15.00", 3: "5.00"}
    rows = [txn(m, merchant=m, amount=a, status="FAILED") for m, a in losses.items()]
    star = tiny_star(spark, rows, merchants=[merchant(m) for m in losses])
    assert [r.merchant_id for r in reports.merchant_pareto(star).collect()] == [1]
    assert [r.merchant_id for r in reports.merchant_pareto(star, cut_pct=94).collect()] == [1]
    crossing = reports.merchant_pareto(star, cut_pct=94, include_crossing=True).collect()
    assert [r.merchant_id for r in crossing] == [1, 2]
    assert [r.cumulative_loss_pct for r in crossing] == [D("80.00"), D("95.00")]


@pytest.mark.parametrize("slices", [None, 1, 13])
def test_running_total_equals_plain_window(spark, slices):
    df = spark.range(5000).select("id", (F.pmod(F.hash("id"), F.lit(7)) + 1).cast("bigint").alias("v"))
    order = [F.desc("v"), F.asc("id")]
    got = running_total(df, order, "v", slices=slices)
    w = Window.orderBy(*order)
    want = df.withColumns(
        {
            "running": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "position": F.row_number().over(w).cast("bigint"),
            "total": F.sum("v").over(Window.partitionBy()),
        }
    )
    columns = ["id", "v", "running", "position", "total"]
    assert got.select(*columns).exceptAll(want.select(*columns)).count() == 0
    assert got.count() == 5000


def test_shares_add_up(star):
    rows = reports.failure_decomposition(star).collect()
    assert abs(sum(r.pct_share_lost_volume for r in rows) - 100) <= D("0.05")
    rows = reports.status_summary_shares(star).collect()
    total = reports.macro_kpis(star).first()
    assert sum(r.transaction_count for r in rows) == total.total_transactions
    assert sum(r.total_volume_inr for r in rows) == total.total_gmv_inr


def test_orphans_are_dropped_by_inner_joins(spark):
    star = tiny_star(spark, [txn(1), txn(2, customer=99, merchant=99, status="FAILED")])
    assert [r.total_transactions for r in reports.segment_matrix(star).collect()] == [1]
    assert reports.top_merchants_by_loss(star).count() == 0


def test_run_sql(spark, star):
    df = suite.run_sql(spark, star, " SELECT count(*) AS n FROM fact_transactions ; ")
    assert df.first().n == 6000
    try:
        suite.run_sql(spark, star, "SELECT nothing FROM nowhere")
        raise AssertionError("expected an error")
    except RuntimeError as e:
        assert "Query execution error" in str(e)


def test_a_failed_report_does_not_stop_the_suite(spark, star, tmp_path):
    broken = suite.Report(9, "Broken", "broken.csv", lambda s: s.fact.select(F.raise_error(F.lit("no such gateway")).cast("string").alias("x")))
    found = suite.run_suite(star, str(tmp_path / "out"), suite=[suite.SUITE[0], broken, suite.SUITE[5]], store=False).collect()
    assert [(r.report_id, r.status) for r in found] == [(1, "EXPORTED"), (9, "FAILED"), (6, "EXPORTED")]
    assert found[1].exported_rows is None and found[1].error and found[0].error is None and found[2].exported_rows == 20


def test_errors_at_run_time_are_wrapped(spark, star):
    with pytest.raises(RuntimeError, match="Query execution error"):
        suite.run_sql_rows(spark, star, "SELECT 1 / (transaction_id - transaction_id) FROM fact_transactions")
    assert suite.run_sql_rows(spark, star, "SELECT 1 AS one")[0].one == 1


def test_suite_exports_readable_files(spark, star, tmp_path):
    lines = suite.run_suite(star, str(tmp_path / "out")).collect()
    assert [r.report_id for r in sorted(lines)] == [1, 2, 3, 4, 5, 6]
    files = {r.file_name: r.exported_rows for r in lines}
    assert files["query1_executive_overview.csv"] == 1
    assert files["query4_merchant_pareto_loss.csv"] == 115
    back = spark.read.csv(str(tmp_path / "out" / "query1_executive_overview.csv"), header=True).first()
    assert D(back.revenue_at_risk_inr) == D("2024701.44")


def test_digest_of_any_report(star):
    row = digests.default(reports.gateway_sla(star)).first()
    assert row.main_column == "total_transactions" and row.total_value == 6000.0


def test_averages_are_over_present_amounts(spark):
    star = tiny_star(spark, [txn(1), txn(2, amount=None), txn(3, status="FAILED"), txn(4, status="FAILED", amount=None)])
    hundred = Decimal("100.00")
    assert {r.avg_ticket_size for r in reports.status_volume(star).collect()} == {hundred}
    assert {r.avg_ticket_size for r in reports.status_summary_shares(star).collect()} == {hundred}
    assert {r.avg_ticket_size for r in reports.channel_performance(star).collect()} == {hundred}
    assert {r.avg_txn_size for r in reports.segment_matrix(star).collect()} == {hundred}
    assert {r.avg_lost_ticket_size for r in reports.top_failure_reasons(star).collect()} == {hundred}
    assert measures.evaluate(star, ["average_ticket_size"], []).first()[0] == 100.0


def test_top_share_of_no_loss_is_zero(spark):
    star = tiny_star(spark, [txn(1, status="FAILED", amount="0.00")])
    assert digests.top_share(reports.leakage_count_share(star)).first().top_pct == 0


def test_pareto_ranks_ids_and_joins_names_after_the_cut(spark, star):
    ranked = reports._losses(star).columns
    assert ranked == ["merchant_id", "failed_txn_count", "loss_cents"]
