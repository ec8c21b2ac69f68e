import pytest
from tiny import customer, merchant, tiny_star, txn

from tillscope.plans import measures as m


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_all_measures_are_named_and_found():
    assert len(m.MEASURES) == 44
    assert m.find("Gateway SLA Status") == "gateway_sla_status"
    with pytest.raises(KeyError):
        m.find("No Such Measure")


def test_filter_replaces_grouping_and_slicer(spark):
    rows = [txn(1, amount="70.00"), txn(2, amount="30.00", status="FAILED"), txn(3, amount="5.00", gateway="Razorpay")]
    star = tiny_star(spark, rows)
    got = by_key(m.evaluate(star, ["successful_volume", "total_gross_volume_gmv"], ["transaction_status"]), "transaction_status")
    assert got["FAILED",].successful_volume == 75 and got["SUCCESS",].successful_volume == 75
    assert got["FAILED",].total_gross_volume_gmv == 30
    sliced = m.evaluate(star, ["successful_volume", "total_transactions"], [], {"transaction_status": m.equals("FAILED")}).first()
    assert (sliced.successful_volume, sliced.total_transactions) == (75, 1)
    shown = m.evaluate(star, ["successful_volume"], ["transaction_status"], {"transaction_status": m.equals("FAILED")})
    assert [(r.transaction_status, r.successful_volume) for r in shown.collect()] == [("FAILED", 75)]


def test_empty_table(spark):
    row = m.evaluate(tiny_star(spark, [], [], []), [*m.CORE, *m.LEAKAGE, *m.CUSTOMER_MERCHANT, *m.GATEWAY_FRAUD]).first()
    assert row.total_gross_volume_gmv is None and row.total_transactions == 0
    assert row.success_rate == 0 and row.infrastructure_loss_share == 0 and row.total_customers == 0
    assert row.top_20_merchant_loss_share == 0


def test_dimension_counts_include_idle_members(spark):
    star = tiny_star(
        spark,
        [txn(1, customer=1), txn(2, customer=1, gateway="Razorpay")],
        [customer(1, segment="Retail"), customer(2, segment="SMB")],
        [merchant(1), merchant(2)],
    )
    assert m.evaluate(star, ["total_customers", "total_merchants"]).first()[:2] == (2, 2)
    per_gateway = by_key(m.evaluate(star, ["total_customers", "total_transactions"], ["gateway"]), "gateway")
    assert {k: r.total_customers for k, r in per_gateway.items()} == {("PayU",): 2, ("Razorpay",): 2}
    per_segment = by_key(m.evaluate(star, ["total_customers", "total_transactions"], ["customer_segment"]), "customer_segment")
    assert per_segment["SMB",].total_customers == 1
    mixed = by_key(m.evaluate(star, ["total_customers"], ["customer_segment", "gateway"]), "customer_segment", "gateway")
    assert mixed["Retail", "PayU"].total_customers == 1


def test_top_twenty_keeps_ties(spark):
    rows = [txn(i, merchant=i, amount="10.00", status="FAILED") for i in range(1, 31)]
    rows += [txn(100, merchant=31, amount="100.00", status="FAILED")]
    rows += [txn(200 + i, merchant=40 + i, amount="1.00", status="FAILED") for i in range(10)]
    merchants = [merchant(i) for i in range(1, 60)]
    share = m.evaluate(tiny_star(spark, rows, merchants=merchants), ["top_20_merchant_loss_share"]).first()[0]
    assert share == pytest.approx(400 / 410)


def test_top_twenty_by_category_is_over_the_global_loss(spark):
    rows = [txn(1, merchant=1, amount="30.00", status="FAILED"), txn(2, merchant=2, amount="70.00", status="FAILED")]
    star = tiny_star(spark, rows, merchants=[merchant(1, "Gaming"), merchant(2, "Utilities")])
    got = by_key(m.evaluate(star, ["top_20_merchant_loss_share"], ["merchant_category"]), "merchant_category")
    assert got["Gaming",][1] == pytest.approx(0.3) and got["Utilities",][1] == pytest.approx(0.7)
    sliced = m.evaluate(star, ["top_20_merchant_loss_share"], [], {"merchant_category": m.equals("Gaming")}).first()
    assert sliced[0] == pytest.approx(0.3)


def test_entities_at_the_thresholds(spark):
    rows = [txn(i, customer=1, amount="5000.00", status="FAILED" if i == 0 else "SUCCESS") for i in range(5)]
    rows += [txn(10 + i, customer=2, amount="4999.99", status="FAILED") for i in range(5)]
    star = tiny_star(spark, rows, [customer(1), customer(2)])
    names = ["high_spend_customers", "at_risk_customers", "at_risk_customer_spend"]
    assert list(m.evaluate(star, names).first()) == [1, 1, 25000]


def test_totals(spark):
    star = tiny_star(spark, [txn(1), txn(2, customer=2, status="FAILED")], [customer(1), customer(2, segment="SMB")])
    df = m.evaluate_with_totals(star, ["Total Transactions", "Failure Rate %"], ["customer_segment", "gateway"])
    rows = by_key(df, "customer_segment", "gateway", "totals_level")
    assert rows[None, None, 2].total_transactions == 2 and rows[None, None, 2].failure_rate == 0.5
    assert rows["SMB", None, 1].failure_rate == 1.0


def test_totals_of_customers_and_lifted_filters(spark):
    """One customer is at risk only over both gateways, so the total is not the sum of the groups."""
    txns = [txn(1, amount="20000.00"), txn(2, amount="10000.00", status="FAILED", gateway="Razorpay"), txn(3, customer=2)]
    star = tiny_star(spark, txns, [customer(1), customer(2, segment="SMB")])
    df = m.evaluate_with_totals(star, ["total_transactions", "at_risk_customers"], ["customer_segment", "gateway"])
    rows = by_key(df, "customer_segment", "gateway", "totals_level")
    assert rows["Retail", "PayU", 0].at_risk_customers == rows["Retail", "Razorpay", 0].at_risk_customers == 0
    assert rows["Retail", None, 1].at_risk_customers == rows[None, None, 2].at_risk_customers == 1
    assert rows[None, None, 2].total_transactions == 3 and len(rows) == 6
    lifted = by_key(m.evaluate_with_totals(star, ["successful_transactions"], ["transaction_status"]), "transaction_status", "totals_level")
    assert {k: r.successful_transactions for k, r in lifted.items()} == {("SUCCESS", 0): 2, ("FAILED", 0): 2, (None, 1): 2}
