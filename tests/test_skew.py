"""Reports and measures on a star where one customer and one merchant hold a third of all rows."""

from __future__ import annotations

import duckdb
import pytest
from check import compare
from pyspark.sql import functions as F
from tiny import tiny_star

import __spark_entry__ as entry_points
from oracles import measures as measure_sql
from oracles import reports as report_sql
from oracles import tests as test_sql
from tillscope.schemas import TABLES
from tillscope.sources.tables import read_star, write_star
from tillscope.star import Star

BODIES = {**report_sql.BODIES, **measure_sql.BODIES, **test_sql.BODIES}
RUNNERS = {
    **entry_points.REPORTS,
    **entry_points.MEASURES,
    **entry_points.STATISTICS,
    **entry_points.DIGESTS,
}


def skewed(spark) -> Star:
    """12,000 rows: hot customer 0 and hot merchant 0, few distinct amounts, missing gateways and risk scores."""
    i = F.col("id")
    mixed = F.pmod(F.xxhash64("id"), F.lit(1000))
    hot = i % 3 == 0
    status = F.when(mixed < 30, "FRAUD_BLOCKED").when(mixed < 330, "FAILED").otherwise("SUCCESS")
    rows = spark.range(12000).select(
        i.alias("transaction_id"),
        F.when(hot, 0).otherwise(i % 211).alias("customer_id"),
        F.when(i % 3 == 1, 0).otherwise(i % 97).alias("merchant_id"),
        (F.lit(1) + mixed % 4).alias("payment_method_id"),
        F.when(status == "FRAUD_BLOCKED", 6).when(status == "FAILED", 1 + mixed % 5).otherwise(0).alias("failure_reason_id"),
        (F.lit("2023-07-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(i % 40, i % 24, i % 60)).alias(
            "transaction_timestamp"
        ),
        (F.lit(100) + (mixed % 7) * 1000).alias("amount"),
        F.lit("Mobile").alias("device_type"),
        F.when(i % 6 > 0, F.element_at(F.array(*map(F.lit, ["PayU", "Razorpay"])), (1 + i % 2).cast("int"))).alias("gateway"),
        F.when(mixed % 11 > 0, (mixed % 1000) / 10).alias("risk_score"),
        status.alias("transaction_status"),
        (mixed % 13 == 0).cast("int").alias("is_international"),
        (status == "FRAUD_BLOCKED").cast("int").alias("is_fraud"),
        F.lit(0).alias("failed_txn_count_24h"),
    )
    fact = rows.select(*[F.col(c.name).cast(c.type).alias(c.name) for c in TABLES["fact_transactions"].columns])
    cities = F.array(*map(F.lit, ["Tier-2 Cities", "Mumbai", "Chennai"]))
    customers = spark.range(220).select(
        F.col("id").alias("customer_id"),
        F.concat(F.lit("Customer_"), "id").alias("customer_name"),
        F.when(F.col("id") % 5 == 0, "Premium").otherwise("Retail").alias("customer_segment"),
        F.element_at(cities, (F.col("id") % 3 + 1).cast("int")).alias("city"),
        F.lit("S").alias("state"),
        *[F.lit(1).alias(c) for c in ("account_age_days", "credit_score_band", "kyc_level")],
        F.lit(1).cast("decimal(12,2)").alias("avg_monthly_spend"),
    )
    merchants = spark.range(100).select(
        F.col("id").alias("merchant_id"),
        F.concat(F.lit("Merchant_"), "id").alias("merchant_name"),
        F.when(F.col("id") % 4 == 0, "Gaming").otherwise("Utilities").alias("merchant_category"),
        F.lit("Mumbai").alias("city"),
        F.lit("S").alias("state"),
        F.lit(0).cast("decimal(6,4)").alias("merchant_risk_score"),
    )
    small = tiny_star(spark, [])
    return Star(fact, customers, merchants, small.methods, small.reasons)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skew") / "star")
    write_star(skewed(spark), folder)
    con = duckdb.connect()
    for name in TABLES:
        extra = ", amount_cents AS cents, CAST(risk_score * 10 AS BIGINT) AS risk_tenths" if "fact" in name else ""
        con.execute(f"CREATE VIEW {name} AS SELECT *{extra} FROM '{folder}/{name}/*.parquet'")
    return read_star(spark, folder), con


@pytest.mark.parametrize("name", sorted(BODIES))
def test_hot_keys(both, name):
    star, con = both
    body = BODIES[name].lstrip()
    sql = "WITH" + body[1:] if body.startswith(",") else body
    assert compare(entry_points.plain(RUNNERS[name](star)), con, sql) == ""
