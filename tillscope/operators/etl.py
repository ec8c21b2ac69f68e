"""From the raw feed to the star schema.

Attributes the feed lacks (segment, city, category, gateway, outcome) are repeatable draws from a hash of the
key, so a lost task that is run again yields the same rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope import schemas
from tillscope.functions.exact import draw, key_digest, pct, weighted_choice
from tillscope.schemas import CITY_STATE, FAILURE_REASONS, PAYMENT_METHODS, TABLES
from tillscope.sources.tables import literal_table
from tillscope.star import Star, is_failed


class PeakSegment(NamedTuple):
    """The segment in which failures peak, and its failure share."""

    month: int = 7
    first_hour: int = 18
    last_hour: int = 22
    channel: str = "upi"
    city: str = "Tier-2 Cities"
    failed_share: str = "0.35"


# Success and failure outside the peak segment.
BASE_SHARES = ("0.88", "0.12")
PEAK_REASON = 4
FRAUD_REASON = 6


def first_values(df: DataFrame, key: str, columns: list[str], order: str = "transaction_id") -> DataFrame:
    """Per key, the first present value of each column in the order of ``order``.

    ``order`` must be unique per key (it is the primary key of the feed). All buffers are fixed width, so this stays
    a hash aggregate and folds hot keys before the shuffle.
    """
    return df.groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The mapped value; NULL where the map has no such key."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def label(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.col(key).cast("string"))


def round_to(name: str, scale: int, precision: int = 12) -> Column:
    """Number as a decimal with ``scale`` places, half up."""
    return F.col(name).cast(f"decimal({precision},{scale})")


def assign(df: DataFrame, key: str, salt: str, **columns: tuple) -> DataFrame:
    """Add weighted hash draws of the key; ``columns`` maps a name to (choices, weights), at most four."""
    slots = {f"_draw{slot}": draw(F.col("_digest"), slot) for slot in range(len(columns))}
    picked = {
        name: weighted_choice(F.col(f"_draw{slot}"), choices, weights)
        for slot, (name, (choices, weights)) in enumerate(columns.items())
    }
    drawn = df.withColumn("_digest", key_digest(F.col(key), salt)).withColumns(slots)
    return drawn.withColumns(picked).drop("_digest", *slots)


def equal_weights(n: int) -> list[str]:
    return [str(round(1 / n, 12))] * n


def split(pairs) -> tuple[list, list]:
    return [p[0] for p in pairs], [p[1] for p in pairs]


def build_customers(raw: DataFrame) -> DataFrame:
    attributes = ["account_age_days", "credit_score_band", "kyc_level", "avg_monthly_spend"]
    rows = assign(
        first_values(raw, "customer_id", attributes),
        "customer_id",
        "customer",
        customer_segment=split(schemas.SEGMENTS),
        city=split(schemas.CUSTOMER_CITIES),
    )
    return _shape(
        rows,
        "dim_customers",
        customer_name=label("Customer", "customer_id"),
        state=lookup(F.col("city"), CITY_STATE),
        avg_monthly_spend=round_to("avg_monthly_spend", 2),
    )


def build_merchants(raw: DataFrame) -> DataFrame:
    rows = assign(
        first_values(raw, "merchant_id", ["merchant_risk_score"]),
        "merchant_id",
        "merchant",
        merchant_category=(schemas.MERCHANT_CATEGORIES, equal_weights(len(schemas.MERCHANT_CATEGORIES))),
        city=(schemas.MERCHANT_CITIES, equal_weights(len(schemas.MERCHANT_CITIES))),
    )
    return _shape(
        rows,
        "dim_merchants",
        merchant_name=label("Merchant", "merchant_id"),
        state=lookup(F.col("city"), CITY_STATE),
        merchant_risk_score=round_to("merchant_risk_score", 4, 6),
    )


def payment_methods(spark: SparkSession) -> DataFrame:
    return literal_table(spark, TABLES["dim_payment_methods"], PAYMENT_METHODS)


def failure_reasons(spark: SparkSession) -> DataFrame:
    return literal_table(spark, TABLES["dim_failure_reasons"], FAILURE_REASONS)


def _shape(df: DataFrame, table: str, **columns: Column) -> DataFrame:
    """The declared columns of a table, in order and type."""
    return df.select(
        *[columns.get(c.name, F.col(c.name)).cast(c.type).alias(c.name) for c in TABLES[table].columns]
    )


def channel_to_id(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """Payment method id of the channel code; NULL for an unknown code."""
    codes = methods.select(F.col("payment_method_code").alias("payment_channel"), "payment_method_id")
    return raw.join(codes, "payment_channel", "left")


def to_seconds(name: str) -> Column:
    """Text time cut to whole seconds; NULL where it does not parse. No step depends on a time zone."""
    time = F.col(name).try_cast("timestamp_ntz")
    zero = F.lit(0)
    return time - F.make_dt_interval(zero, zero, zero, F.date_part(F.lit("SECOND"), time) % 1)


def seconds_text(name: str) -> Column:
    return to_seconds(name).cast("string")


def capitalize(name: str) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substr(F.col(name), F.lit(2))))


def scale_risk(name: str) -> Column:
    """A 0-1 score as 0.0-100.0 with one decimal."""
    return (F.col(name) * 100.0).cast("decimal(12,8)").cast("decimal(5,1)")


def _could_peak(w: PeakSegment) -> Column:
    """What the feed itself says about the peak segment; only the city is still open.

    The cheap tests come first, so that the time is parsed only where they pass.
    """
    t = to_seconds("transaction_time")
    return F.coalesce(
        (F.col("payment_channel") == w.channel)
        & (F.col("is_fraud") != 1)
        & (F.month(t) == w.month)
        & F.hour(t).between(w.first_hour, w.last_hour),
        F.lit(False),
    )


def drawn_city() -> Column:
    """The city that ``build_customers`` draws for a customer; NULL where the row has none."""
    choice = weighted_choice(draw(key_digest(F.col("customer_id"), "customer"), 1), *split(schemas.CUSTOMER_CITIES))
    return F.when(F.col("customer_id").isNotNull(), choice)


def mark_peak(raw: DataFrame, customers: DataFrame | None = None, w: PeakSegment = PeakSegment()) -> DataFrame:
    """Add ``is_peak``.

    Without ``customers`` the city is drawn on the row, which needs no join. With them, only the few rows that could be in the
    peak segment are joined to the customers' city; all others pass without a shuffle.
    """
    if customers is None:
        return raw.withColumn("is_peak", F.coalesce(_could_peak(w) & (drawn_city() == w.city), F.lit(False)))
    residents = customers.where(F.col("city") == w.city).select("customer_id", F.lit(True).alias("is_peak"))
    near = (
        raw.where(_could_peak(w))
        .join(residents, "customer_id", "left")
        .withColumn("is_peak", F.coalesce("is_peak", F.lit(False)))
    )
    return raw.where(~_could_peak(w)).withColumn("is_peak", F.lit(False)).unionByName(near)


def label_status(marked: DataFrame, w: PeakSegment = PeakSegment()) -> DataFrame:
    """Add gateway, status and failure reason; the first rule that fits decides.

    Fraud is blocked; the peak segment fails by timeout at its own share; the rest fails at the base share for
    weighted reasons. One digest per row gives all three draws.
    """
    fraud, peak, luck = F.col("is_fraud") == 1, F.col("is_peak"), F.col("_draw1")
    digest = F.col("_digest")
    failed = F.when(peak, weighted_choice(luck, [True, False], [w.failed_share, "1"])).otherwise(
        weighted_choice(luck, [False, True], BASE_SHARES)
    )
    # Each draw is a column of its own, so that a chain of comparisons does not compute it again.
    drawn = marked.withColumn("_digest", key_digest(F.col("transaction_id"), "transaction")).withColumns(
        {f"_draw{slot}": draw(digest, slot) for slot in range(3)}
    )
    return (
        drawn.withColumns(
            {
                "gateway": weighted_choice(F.col("_draw0"), *split(schemas.GATEWAYS)),
                "_failed": failed,
                "_reason": weighted_choice(F.col("_draw2"), *split(schemas.BASE_REASONS)),
            }
        )
        .withColumns(
            {
                "transaction_status": F.when(fraud, "FRAUD_BLOCKED")
                .when(F.col("_failed"), "FAILED")
                .otherwise("SUCCESS"),
                "failure_reason_id": F.when(fraud, FRAUD_REASON)
                .when(~F.col("_failed"), 0)
                .when(peak, PEAK_REASON)
                .otherwise(F.col("_reason")),
            }
        )
        .drop("_digest", "_draw0", "_draw1", "_draw2", "_reason", "_failed")
    )


def build_fact(raw: DataFrame, customers: DataFrame | None, methods: DataFrame, w: PeakSegment = PeakSegment()) -> DataFrame:
    """The 14 fact columns; ``customers`` as for ``mark_peak``."""
    labelled = label_status(mark_peak(channel_to_id(raw, methods), customers, w), w)
    return _shape(
        labelled,
        "fact_transactions",
        transaction_timestamp=to_seconds("transaction_time"),
        amount=round_to("transaction_amount", 2),
        device_type=capitalize("device_type"),
        risk_score=scale_risk("post_auth_risk_score"),
    )


def build_star(raw: DataFrame) -> Star:
    spark = raw.sparkSession
    methods = payment_methods(spark)
    return Star(
        build_fact(raw, None, methods), build_customers(raw), build_merchants(raw), methods, failure_reasons(spark)
    )


def status_distribution(star: Star) -> DataFrame:
    return (
        star.fact.groupBy("transaction_status")
        .agg(F.count("*").alias("transaction_count"))
        .withColumn("status_pct", pct(F.col("transaction_count"), F.sum("transaction_count").over(Window.partitionBy())))
        .orderBy(F.desc("transaction_count"), "transaction_status")
    )


def reason_distribution(star: Star) -> DataFrame:
    """Rows and percent per reason id, with the code, or UNKNOWN where the dimension has no such id."""
    counted = star.fact.groupBy("failure_reason_id").agg(F.count("*").alias("transaction_count"))
    return (
        counted.withColumn(
            "reason_pct", pct(F.col("transaction_count"), F.sum("transaction_count").over(Window.partitionBy()))
        )
        .join(star.reasons.select("failure_reason_id", "failure_reason_code"), "failure_reason_id", "left")
        .select(
            "failure_reason_id",
            F.coalesce("failure_reason_code", F.lit("UNKNOWN")).alias("failure_reason_code"),
            "transaction_count",
            "reason_pct",
        )
        .orderBy("failure_reason_id")
    )


def peak_totals(star: Star, w: PeakSegment = PeakSegment()) -> DataFrame:
    """One row: non-fraud rows and failures, of all and of the peak segment, and flag disagreements.

    The customers' city meets one grouped row per customer, not the fact rows. A customer the dimension does not know
    counts to the rest.
    """
    clean = F.col("is_fraud") == 0
    near = (
        clean
        & (F.month("transaction_timestamp") == w.month)
        & F.hour("transaction_timestamp").between(w.first_hour, w.last_hour)
        & (F.col("payment_method_code") == w.channel)
    )
    blocked = F.col("transaction_status") == "FRAUD_BLOCKED"
    per_customer = (
        star.fact.join(star.methods.select("payment_method_id", "payment_method_code"), "payment_method_id", "left")
        .groupBy("customer_id")
        .agg(
            F.count_if(clean).alias("n"),
            F.count_if(clean & is_failed()).alias("x"),
            F.count_if(near).alias("near_n"),
            F.count_if(near & is_failed()).alias("near_x"),
            F.count_if(blocked != (F.col("is_fraud") == 1)).alias("flags"),
        )
    )
    residents = star.customers.where(F.col("city") == w.city).select("customer_id", F.lit(1).alias("home"))
    total = {
        "non_fraud_n": F.sum("n"),
        "non_fraud_x": F.sum("x"),
        "peak_n": F.sum(F.when(F.col("home") == 1, F.col("near_n"))),
        "peak_x": F.sum(F.when(F.col("home") == 1, F.col("near_x"))),
        "flag_disagreements": F.sum("flags"),
    }
    zero = F.lit(0).cast("bigint")
    return per_customer.join(residents, "customer_id", "left").agg(
        *[F.coalesce(c, zero).alias(n) for n, c in total.items()]
    )


def scenario_verification(star: Star, w: PeakSegment = PeakSegment()) -> DataFrame:
    """Total, failed and failure percent for the peak segment, the rest, and all non-fraud rows."""
    n, x = F.col("non_fraud_n"), F.col("non_fraud_x")
    scopes = {
        "peak": (F.col("peak_n"), F.col("peak_x")),
        "baseline": (n - F.col("peak_n"), x - F.col("peak_x")),
        "non_fraud": (n, x),
    }
    lines = [
        F.struct(
            F.lit(scope).alias("scope"),
            total.alias("total_txns"),
            failed.alias("failed_txns"),
            F.coalesce(pct(failed, total), F.lit(0).cast("decimal(20,2)")).alias("failure_rate_pct"),
            F.col("flag_disagreements"),
        )
        for scope, (total, failed) in scopes.items()
    ]
    return peak_totals(star, w).select(F.inline(F.array(*lines)))
