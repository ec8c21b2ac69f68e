"""Table contract of the star schema and of the raw feed.

Entity keys are BIGINT rather than INT, so that keys beyond 2^31 still load.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

INT, BIG, TEXT, REAL, TIME = IntegerType(), LongType(), StringType(), DoubleType(), TimestampNTZType()
MONEY = DecimalType(12, 2)


class ColumnRule(NamedTuple):
    name: str
    type: object
    required: bool = True
    max_length: int | None = None


class Table(NamedTuple):
    name: str
    key: str
    columns: tuple[ColumnRule, ...]

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c.name, c.type, True) for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


C = ColumnRule

TABLES = {
    t.name: t
    for t in (
        Table(
            "dim_customers",
            "customer_id",
            (
                C("customer_id", BIG),
                C("customer_name", TEXT, True, 100),
                C("customer_segment", TEXT, True, 50),
                C("city", TEXT, True, 100),
                C("state", TEXT, True, 100),
                C("account_age_days", INT),
                C("credit_score_band", INT),
                C("kyc_level", INT),
                C("avg_monthly_spend", MONEY),
            ),
        ),
        Table(
            "dim_merchants",
            "merchant_id",
            (
                C("merchant_id", BIG),
                C("merchant_name", TEXT, True, 100),
                C("merchant_category", TEXT, True, 100),
                C("city", TEXT, True, 100),
                C("state", TEXT, True, 100),
                C("merchant_risk_score", DecimalType(6, 4)),
            ),
        ),
        Table(
            "dim_payment_methods",
            "payment_method_id",
            (
                C("payment_method_id", INT),
                C("payment_method_code", TEXT, True, 50),
                C("payment_method_name", TEXT, True, 100),
                C("category_type", TEXT, True, 50),
            ),
        ),
        Table(
            "dim_failure_reasons",
            "failure_reason_id",
            (
                C("failure_reason_id", INT),
                C("failure_reason_code", TEXT, True, 50),
                C("failure_reason_description", TEXT, True, 255),
                C("failure_category", TEXT, True, 50),
            ),
        ),
        Table(
            "fact_transactions",
            "transaction_id",
            (
                C("transaction_id", BIG),
                C("customer_id", BIG),
                C("merchant_id", BIG),
                C("payment_method_id", INT),
                C("failure_reason_id", INT),
                C("transaction_timestamp", TIME),
                C("amount", MONEY),
                C("device_type", TEXT, False, 50),
                C("gateway", TEXT, False, 50),
                C("risk_score", DecimalType(5, 1), False),
                C("transaction_status", TEXT, True, 50),
                C("is_international", INT, False),
                C("is_fraud", INT, False),
                C("failed_txn_count_24h", INT, False),
            ),
        ),
    )
}

# Columns with a default of 0 in the contract.
ZERO_DEFAULTS = ("is_international", "is_fraud", "failed_txn_count_24h")

# Foreign keys of the fact: label, fact column, table.
FOREIGN_KEYS = (
    ("customers", "customer_id", "dim_customers"),
    ("merchants", "merchant_id", "dim_merchants"),
    ("payment_methods", "payment_method_id", "dim_payment_methods"),
    ("failure_reasons", "failure_reason_id", "dim_failure_reasons"),
)

RAW_FEED = StructType(
    [
        StructField("transaction_id", BIG),
        StructField("transaction_time", TEXT),
        StructField("customer_id", BIG),
        StructField("merchant_id", BIG),
        StructField("account_age_days", BIG),
        StructField("credit_score_band", BIG),
        StructField("kyc_level", BIG),
        StructField("avg_monthly_spend", REAL),
        StructField("merchant_risk_score", REAL),
        StructField("transaction_amount", REAL),
        StructField("payment_channel", TEXT),
        StructField("device_type", TEXT),
        StructField("is_international", BIG),
        StructField("ip_risk_score", REAL),
        StructField("txn_count_1h", BIG),
        StructField("txn_count_24h", BIG),
        StructField("failed_txn_count_24h", BIG),
        StructField("geo_distance_from_last_txn", REAL),
        StructField("amount_deviation_from_user_mean", REAL),
        StructField("is_fraud", BIG),
        StructField("post_auth_risk_score", REAL),
    ]
)

# Payment methods (id, code, name, type).
PAYMENT_METHODS = (
    (1, "card", "Credit/Debit Card", "Card"),
    (2, "upi", "UPI Instant Pay", "Instant Pay"),
    (3, "wallet", "Digital Wallet", "Prepaid"),
    (4, "bank_transfer", "Net Banking Transfer", "Direct Bank"),
)

# Failure reasons (id, code, description, category).
FAILURE_REASONS = (
    (0, "SUCCESS", "Transaction Successful", "None"),
    (1, "INSUFFICIENT_FUNDS", "Insufficient Customer Account Balance", "Customer Side"),
    (2, "BANK_DECLINED", "Declined by Issuing Bank", "Customer Side"),
    (3, "TECHNICAL_ERROR", "Gateway/Switch Technical Exception", "Infrastructure"),
    (4, "GATEWAY_TIMEOUT", "Acquirer Latency Timeout", "Infrastructure"),
    (5, "AUTHENTICATION_FAILED", "OTP / 3DS Auth Failed", "Risk & Compliance"),
    (6, "RISK_BLOCKED", "Blocked by Fraud Risk Engine", "Risk & Compliance"),
)

# City to state.
CITY_STATE = {
    "Mumbai": "Maharashtra",
    "Bengaluru": "Karnataka",
    "Delhi NCR": "Delhi",
    "Hyderabad": "Telangana",
    "Chennai": "Tamil Nadu",
    "Tier-2 Cities": "Tier-2 Regions",
}

# Choices of the derived attributes with their weights.
SEGMENTS = (("Retail", "0.50"), ("Premium", "0.20"), ("Corporate", "0.10"), ("SMB", "0.20"))
CUSTOMER_CITIES = (
    ("Mumbai", "0.25"),
    ("Bengaluru", "0.25"),
    ("Delhi NCR", "0.20"),
    ("Hyderabad", "0.12"),
    ("Chennai", "0.08"),
    ("Tier-2 Cities", "0.10"),
)
MERCHANT_CATEGORIES = (
    "E-commerce",
    "Travel & Hospitality",
    "Utilities",
    "Gaming",
    "Food & Dining",
    "Financial Services",
)
MERCHANT_CITIES = ("Mumbai", "Bengaluru", "Delhi NCR", "Hyderabad", "Chennai")
GATEWAYS = (
    ("Razorpay", "0.35"),
    ("PayU", "0.25"),
    ("Cashfree", "0.15"),
    ("HDFC Direct", "0.15"),
    ("Paytm Gateway", "0.10"),
)
BASE_REASONS = ((1, "0.35"), (2, "0.25"), (3, "0.18"), (4, "0.12"), (5, "0.10"))
STATUSES = ("SUCCESS", "FAILED", "FRAUD_BLOCKED")
