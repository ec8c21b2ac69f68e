"""Hand-made stars for edge cases."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from tillscope.schemas import FAILURE_REASONS, PAYMENT_METHODS, TABLES
from tillscope.sources.tables import literal_table
from tillscope.star import Star

NOON = datetime(2023, 7, 3, 12, 0, 0)


def txn(tid, customer=1, merchant=1, amount="100.00", status="SUCCESS", **more):
    reason = {"SUCCESS": 0, "FAILED": 4, "FRAUD_BLOCKED": 6}.get(status, 0)
    row = {
        "transaction_id": tid,
        "customer_id": customer,
        "merchant_id": merchant,
        "payment_method_id": 2,
        "failure_reason_id": reason,
        "transaction_timestamp": NOON,
        "amount": None if amount is None else Decimal(amount),
        "device_type": "Mobile",
        "gateway": "PayU",
        "risk_score": Decimal("10.0"),
        "transaction_status": status,
        "is_international": 0,
        "is_fraud": int(status == "FRAUD_BLOCKED"),
        "failed_txn_count_24h": 0,
    }
    return row | more


def customer(cid, city="Mumbai", segment="Retail"):
    return (cid, f"Customer_{cid}", segment, city, "Maharashtra", 100, 1, 1, Decimal("10.00"))


def merchant(mid, category="Gaming"):
    return (mid, f"Merchant_{mid}", category, "Mumbai", "Maharashtra", Decimal("0.1000"))


def tiny_star(spark, txns, customers=None, merchants=None) -> Star:
    fact = TABLES["fact_transactions"]
    rows = [tuple(t[c] for c in fact.names) for t in txns]
    customers = customers if customers is not None else [customer(1)]
    merchants = merchants if merchants is not None else [merchant(1)]
    return Star(
        spark.createDataFrame(rows, fact.schema),
        spark.createDataFrame(customers, TABLES["dim_customers"].schema),
        spark.createDataFrame(merchants, TABLES["dim_merchants"].schema),
        literal_table(spark, TABLES["dim_payment_methods"], PAYMENT_METHODS),
        literal_table(spark, TABLES["dim_failure_reasons"], FAILURE_REASONS),
    )
