"""Star view and raw feed over the order-line tables of the test data.

Each line item is one payment transaction. All columns are formulas of the keys; the only join of the fact
is line items to orders, on the order key. The star and the feed are built once per session and sf_dir and
kept as Parquet under the shared folder; queries scan what was stored, with their filters and columns pushed
to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tillscope.functions.exact import to_money
from tillscope.schemas import CITY_STATE, FAILURE_REASONS, GATEWAYS, PAYMENT_METHODS, RAW_FEED, TABLES
from tillscope.session import content_mark, fresh_path
from tillscope.sources.tables import literal_table
from tillscope.star import Star


# Columns read from the input tables; a declared schema saves reading every file's footer to infer one.
INPUTS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_extendedprice double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_type string",
}

_stored: dict[tuple[str, ...], str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(INPUTS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _store_once(spark: SparkSession, sf_dir: str, name: str, build, schema: StructType) -> DataFrame:
    """The table ``build`` makes, written on first use in a session and scanned from then on, until an input file changes."""
    marks = ";".join(content_mark(spark, f"{sf_dir}/{table}.parquet") for table in INPUTS)
    key = (spark.sparkContext.applicationId, sf_dir, name, marks)
    if key not in _stored:
        path = fresh_path(spark, name)
        build(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _stored[key] = path
    return spark.read.schema(schema).parquet(_stored[key])


def _steps(value: Column, steps: list[tuple[int, object]], last: object) -> Column:
    """The label of the first step whose limit is above ``value``."""
    out = F.lit(last)
    for limit, label in reversed(steps):
        out = F.when(value < limit, F.lit(label)).otherwise(out)
    return out


def _city(key: Column) -> Column:
    return _steps(
        key % 20,
        [(5, "Mumbai"), (10, "Bengaluru"), (14, "Delhi NCR"), (16, "Hyderabad"), (18, "Chennai")],
        "Tier-2 Cities",
    )


def _merchant_city(key: Column) -> Column:
    return _steps(
        key % 5, [(1, "Mumbai"), (2, "Bengaluru"), (3, "Delhi NCR"), (4, "Hyderabad")], "Chennai"
    )


def _state(city: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, state in CITY_STATE.items():
        out = F.when(city == name, F.lit(state)).otherwise(out)
    return out


def _age(key: Column) -> Column:
    return F.lit(30) + (key * 37) % 1970


def _spend_cents(balance: Column) -> Column:
    return F.round(F.abs(balance) * 100).cast("bigint")


def _risk(key: Column) -> Column:
    return (((key * 13) % 10000).cast("decimal(5,0)") * F.lit(Decimal("0.0001"))).cast("decimal(6,4)")


def build_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, city = F.col("c_custkey"), _city(F.col("c_custkey"))
    return _read(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.concat(F.lit("Customer_"), key.cast("string")).alias("customer_name"),
        F.col("c_mktsegment").alias("customer_segment"),
        city.alias("city"),
        _state(city).alias("state"),
        _age(key).cast("int").alias("account_age_days"),
        (F.lit(1) + key % 5).cast("int").alias("credit_score_band"),
        (F.lit(1) + key % 3).cast("int").alias("kyc_level"),
        to_money(_spend_cents(F.col("c_acctbal"))).cast("decimal(12,2)").alias("avg_monthly_spend"),
    )


def build_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, city = F.col("p_partkey"), _merchant_city(F.col("p_partkey"))
    return _read(spark, sf_dir, "part").select(
        key.alias("merchant_id"),
        F.concat(F.lit("Merchant_"), key.cast("string")).alias("merchant_name"),
        F.col("p_type").alias("merchant_category"),
        city.alias("city"),
        _state(city).alias("state"),
        _risk(key).alias("merchant_risk_score"),
    )


def _lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Line items with their order's columns, plus the helper columns that set the status."""
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    hour = (o * 7 + n * 5 + s) % 24
    method = _steps((p * 7 + o) % 20, [(10, 1), (15, 2), (18, 3)], 4)
    score = (o * 31 + p * 17 + n * 7) % 100
    hot = (
        (F.col("method") == 2)
        & (F.col("o_custkey") % 20 >= 18)
        & (F.month("ts") == 7)
        & F.col("hour").between(18, 22)
    )
    return (
        joined.withColumns(
            {
                "hour": hour.cast("int"),
                "method": method,
                "score": score,
                "cents": F.call_function(
                    "div", F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.lit(20)
                ),
            }
        )
        .withColumn(
            "ts",
            F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour")),
        )
        .withColumn("hot", hot)
        .withColumn(
            "status",
            F.when(score >= 98, F.lit("FRAUD_BLOCKED"))
            .when(
                score
                < F.when(F.col("hot"), 35).when(F.col("o_custkey") % 25 == 0, 32).otherwise(12),
                F.lit("FAILED"),
            )
            .otherwise(F.lit("SUCCESS")),
        )
    )


def _fact_columns() -> dict[str, Column]:
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return {
        "transaction_id": o * 10 + n,
        "customer_id": F.col("o_custkey"),
        "merchant_id": p,
        "payment_method_id": F.col("method"),
        "failure_reason_id": F.when(F.col("status") == "FRAUD_BLOCKED", 6)
        .when(F.col("status") == "SUCCESS", 0)
        .when(F.col("hot"), 4)
        .otherwise((F.lit(1) + (o + s) % 5).cast("int")),
        "transaction_timestamp": F.col("ts"),
        "amount": to_money(F.col("cents")).cast("decimal(12,2)"),
        "device_type": _steps((o + p) % 20, [(14, "Mobile"), (19, "Desktop")], "Tablet"),
        "gateway": _steps((o + n) % 5, [(i + 1, g[0]) for i, g in enumerate(GATEWAYS[:-1])], GATEWAYS[-1][0]),
        "risk_score": F.when(
            o % 97 != 0,
            (((o * 13 + n * 101) % 1001).cast("decimal(5,0)") * F.lit(Decimal("0.1"))).cast("decimal(5,1)"),
        ),
        "transaction_status": F.col("status"),
        "is_international": F.when(o % 100 < 7, 1).otherwise(0),
        "is_fraud": F.when(F.col("status") == "FRAUD_BLOCKED", 1).otherwise(0),
        "failed_txn_count_24h": (o % 5).cast("int"),
        "amount_cents": F.col("cents"),
    }


def build_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact, each file sorted by status: a scan for failures can skip the row groups of successes."""
    lines = _lines(_read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders"))
    rows = lines.select(*[c.alias(name) for name, c in _fact_columns().items()])
    return rows.sortWithinPartitions("transaction_status")


def star_view(spark: SparkSession, sf_dir: str) -> Star:
    def stored(name: str, build, extra: Sequence[StructField] = ()) -> Callable[[], DataFrame]:
        schema = StructType([*TABLES[name].schema.fields, *extra])
        return lambda: _store_once(spark, sf_dir, name, build, schema)

    return Star(
        stored("fact_transactions", build_fact, [StructField("amount_cents", LongType())]),
        stored("dim_customers", build_customers),
        stored("dim_merchants", build_merchants),
        lambda: literal_table(spark, TABLES["dim_payment_methods"], PAYMENT_METHODS),
        lambda: literal_table(spark, TABLES["dim_failure_reasons"], FAILURE_REASONS),
    )


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store_once(spark, sf_dir, "raw_feed", build_raw_feed, RAW_FEED)


def build_raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat 21-column feed the ETL starts from.

    Customers are joined to orders before the line items are: the next join is on another key, so a hot
    customer's orders may be split over many tasks.
    """
    buyer = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    orders = (
        _read(spark, sf_dir, "orders")
        .join(buyer, F.col("o_custkey") == F.col("c_custkey"))
        .drop("c_custkey")
    )
    lines = _lines(_read(spark, sf_dir, "lineitem"), orders)
    f = _fact_columns()
    o, n, c = F.col("l_orderkey"), F.col("l_linenumber"), F.col("o_custkey")
    columns = {
        "transaction_id": f["transaction_id"],
        "transaction_time": F.concat(F.col("ts").cast("string"), F.lit(".328105993")),
        "customer_id": f["customer_id"],
        "merchant_id": f["merchant_id"],
        "account_age_days": _age(c),
        "credit_score_band": F.lit(1) + c % 5,
        "kyc_level": F.lit(1) + c % 3,
        "avg_monthly_spend": _spend_cents(F.col("c_acctbal")).cast("double") / 100.0,
        "merchant_risk_score": ((F.col("l_partkey") * 13) % 10000).cast("double") / 10000.0,
        "transaction_amount": F.col("cents").cast("double") / 100.0,
        "payment_channel": _steps(F.col("method"), [(2, "card"), (3, "upi"), (4, "wallet")], "bank_transfer"),
        "device_type": F.lower(f["device_type"]),
        "is_international": f["is_international"],
        "ip_risk_score": ((o * 3 + n) % 1000).cast("double") / 1000.0,
        "txn_count_1h": o % 3,
        "txn_count_24h": o % 7,
        "failed_txn_count_24h": f["failed_txn_count_24h"],
        "geo_distance_from_last_txn": ((o * 11 + n) % 2000).cast("double") / 10.0,
        "amount_deviation_from_user_mean": (F.col("cents") - 250000).cast("double") / 100.0,
        "is_fraud": f["is_fraud"],
        "post_auth_risk_score": F.when(o % 97 != 0, ((o * 13 + n * 101) % 1001).cast("double") / 1000.0),
    }
    return lines.select(
        *[columns[field.name].cast(field.dataType).alias(field.name) for field in RAW_FEED]
    )
