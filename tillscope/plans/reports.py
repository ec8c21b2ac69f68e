"""Named reports over the star.

Every report groups the fact by keys first and joins names to the grouped rows, so no text is shuffled and
a hot customer or merchant is folded on the map side before any exchange. Money columns are exact decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.functions.exact import avg_money, avg_tenths, pct, ratio, to_money
from tillscope.operators.prefix import running_total
from tillscope.star import Star, cents_where, cents_where_or_zero, is_failed, is_leakage, rows_where

TIMEOUT, TECH_ERROR = "GATEWAY_TIMEOUT", "TECHNICAL_ERROR"
OFF_HOURS = "Off-Hours (12 AM - 5 AM)"
DAY_HOURS = "Standard Operating Hours (6 AM - 11 PM)"
# Churn tiers, from the most severe to the rest.
TIER_NAMES = ("Tier 1 - Critical Churn Risk", "Tier 2 - Severe Churn Risk", "Tier 3 - Moderate Churn Risk")


def priced() -> Column:
    """Rows that have an amount; an average is over these."""
    return F.count("amount_cents")


def rows() -> Column:
    return F.count("*")


def cents() -> Column:
    return F.sum("amount_cents")


def status_is(status: str) -> Column:
    return F.col("transaction_status") == status


def risk_tenths() -> Column:
    return (F.col("risk_score") * 10).cast("bigint")


def txn_hour() -> Column:
    return F.hour("transaction_timestamp")


def in_hours(first_hour: int, last_hour: int) -> Column:
    return txn_hour().between(first_hour, last_hour)


def add_up(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def money(cents_col: str, name: str) -> Column:
    return to_money(F.col(cents_col)).alias(name)


def _status_totals(star: Star) -> DataFrame:
    """One row: rows and cents, overall and by status; a status without rows has NULL cents."""
    aggs = [rows().alias("n"), cents().alias("c")]
    for tag, status in (("s", "SUCCESS"), ("f", "FAILED"), ("b", "FRAUD_BLOCKED")):
        aggs += [rows_where(status_is(status)).alias(f"{tag}n"), cents_where(status_is(status)).alias(f"{tag}c")]
    return star.fact.agg(*aggs)


def macro_kpis(star: Star) -> DataFrame:
    n = F.col("n")
    return _status_totals(star).select(
        n.alias("total_transactions"),
        money("c", "total_gmv_inr"),
        F.col("sn").alias("successful_txn_count"),
        money("sc", "successful_volume_inr"),
        F.col("fn").alias("failed_txn_count"),
        money("fc", "revenue_at_risk_inr"),
        F.col("bn").alias("fraud_blocked_count"),
        money("bc", "fraud_blocked_volume_inr"),
        pct(F.col("sn"), n).alias("overall_success_rate_pct"),
        pct(F.col("fn"), n).alias("overall_failure_rate_pct"),
        pct(F.col("bn"), n).alias("fraud_rate_pct"),
    )


def macro_kpis_zero(star: Star) -> DataFrame:
    """The overview with 0 for the volume of a status without rows, where the table has rows at all."""
    n = F.col("n")

    def volume(name: str) -> Column:
        return to_money(F.when(n > 0, F.coalesce(F.col(name), F.lit(0))))

    return _status_totals(star).select(
        n.alias("total_transactions"),
        money("c", "total_gmv_inr"),
        volume("sc").alias("successful_volume_inr"),
        volume("fc").alias("revenue_at_risk_inr"),
        volume("bc").alias("fraud_blocked_inr"),
        pct(F.col("sn"), n).alias("success_rate_pct"),
        pct(F.col("fn"), n).alias("failure_rate_pct"),
        pct(F.col("bn"), n).alias("fraud_rate_pct"),
    )


def channel_performance(star: Star) -> DataFrame:
    by_id = star.fact.groupBy("payment_method_id").agg(
        rows().alias("n"),
        cents().alias("c"),
        priced().alias("cn"),
        rows_where(status_is("SUCCESS")).alias("sn"),
        rows_where(is_failed()).alias("fn"),
    )
    n = F.col("n")
    return (
        by_id.join(star.methods, "payment_method_id")
        .groupBy("payment_method_name", "category_type")
        .agg(*add_up("n", "c", "cn", "sn", "fn"))
        .select(
            "payment_method_name",
            "category_type",
            n.alias("total_attempts"),
            money("c", "total_volume_inr"),
            avg_money(F.col("c"), F.col("cn")).alias("avg_ticket_size"),
            F.col("sn").alias("success_count"),
            F.col("fn").alias("failed_count"),
            pct(F.col("sn"), n).alias("success_rate_pct"),
            pct(F.col("fn"), n).alias("failure_rate_pct"),
        )
        .orderBy(F.desc("total_volume_inr"), "payment_method_name")
    )


def segment_matrix(star: Star) -> DataFrame:
    """Distinct customers need no distinct aggregate: there is one grouped row per customer."""
    by_customer = star.fact.groupBy("customer_id").agg(
        rows().alias("n"), cents().alias("c"), priced().alias("cn"), rows_where(is_failed()).alias("fn")
    )
    n = F.col("n")
    return (
        by_customer.join(star.customers.select("customer_id", "customer_segment"), "customer_id")
        .groupBy("customer_segment")
        .agg(rows().alias("total_customers"), *add_up("n", "c", "cn", "fn"))
        .select(
            "customer_segment",
            "total_customers",
            n.alias("total_transactions"),
            money("c", "total_spend_inr"),
            avg_money(F.col("c"), F.col("cn")).alias("avg_txn_size"),
            pct(F.col("fn"), n).alias("segment_failure_rate_pct"),
        )
        .orderBy(F.desc("total_spend_inr"), "customer_segment")
    )


def offhours_fraud(star: Star, first_hour: int = 0, last_hour: int = 5, min_amount: int = 5000) -> DataFrame:
    fraud = F.col("is_fraud") == 1
    n = F.col("n")
    return (
        star.fact.groupBy(
            F.when(in_hours(first_hour, last_hour), OFF_HOURS).otherwise(DAY_HOURS).alias("time_window")
        )
        .agg(
            rows().alias("n"),
            cents().alias("c"),
            rows_where(fraud).alias("bn"),
            cents_where(fraud).alias("bc"),
            F.sum(risk_tenths()).alias("r"),
            F.count("risk_score").alias("rn"),
            rows_where(fraud & (F.col("amount_cents") > min_amount * 100)).alias("high"),
        )
        .select(
            "time_window",
            n.alias("total_transactions"),
            money("c", "total_volume_inr"),
            F.col("bn").alias("fraud_count"),
            money("bc", "fraud_volume_inr"),
            pct(F.col("bn"), n).alias("fraud_rate_pct"),
            avg_tenths(F.col("r"), F.col("rn")).alias("mean_risk_score"),
            F.col("high").alias("high_ticket_fraud_count"),
        )
        .orderBy(F.desc("fraud_rate_pct"), "time_window")
    )


def offhours_surge_ratio(
    star: Star, first_hour: int = 0, last_hour: int = 5, min_amount: int = 5000
) -> DataFrame:
    """Fraud rate of large tickets in the off hours over that of the rest of the day."""
    night, fraud = in_hours(first_hour, last_hour), F.col("is_fraud") == 1
    return (
        star.fact.where(F.col("amount_cents") > min_amount * 100)
        .agg(
            rows_where(night).alias("offhours_txns"),
            rows_where(night & fraud).alias("offhours_fraud"),
            rows_where(~night).alias("daytime_txns"),
            rows_where(~night & fraud).alias("daytime_fraud"),
        )
        .withColumn(
            "surge_ratio",
            F.try_divide(
                ratio(F.col("offhours_fraud"), F.col("offhours_txns")),
                ratio(F.col("daytime_fraud"), F.col("daytime_txns")),
            ),
        )
    )


def corridor_risk(star: Star) -> DataFrame:
    fraud = F.col("is_fraud") == 1
    n = F.col("n")
    return (
        star.fact.groupBy("is_international")
        .agg(
            rows().alias("n"),
            cents().alias("c"),
            rows_where(fraud).alias("bn"),
            cents_where(fraud).alias("bc"),
            F.sum(risk_tenths()).alias("r"),
            F.count("risk_score").alias("rn"),
        )
        .select(
            F.when(F.col("is_international") == 1, "International").otherwise("Domestic").alias("corridor_type"),
            n.alias("total_transactions"),
            money("c", "total_gmv_inr"),
            F.col("bn").alias("fraud_txns"),
            money("bc", "fraud_gmv_inr"),
            pct(F.col("bn"), n).alias("fraud_rate_pct"),
            avg_tenths(F.col("r"), F.col("rn")).alias("avg_post_auth_risk_score"),
        )
        .orderBy(F.desc("total_transactions"), "corridor_type")
    )


def category_fraud(star: Star) -> DataFrame:
    fraud = F.col("is_fraud") == 1
    by_merchant = star.fact.groupBy("merchant_id").agg(
        rows().alias("n"), rows_where(fraud).alias("bn"), cents_where(fraud).alias("bc")
    )
    return (
        by_merchant.join(star.merchants.select("merchant_id", "merchant_category"), "merchant_id")
        .groupBy("merchant_category")
        .agg(*add_up("n", "bn", "bc"))
        .select(
            "merchant_category",
            F.col("n").alias("total_attempts"),
            F.col("bn").alias("fraud_incidents"),
            money("bc", "fraud_loss_inr"),
            pct(F.col("bn"), F.col("n")).alias("category_fraud_rate_pct"),
        )
        .orderBy(F.desc_nulls_first("fraud_loss_inr"), "merchant_category")
    )


MERCHANT_NAMES = ("merchant_id", "merchant_name", "merchant_category", "city")


def _losses(star: Star) -> DataFrame:
    """Failed rows and cents per merchant id."""
    return (
        star.fact.where(is_failed())
        .groupBy("merchant_id")
        .agg(rows().alias("failed_txn_count"), cents().alias("loss_cents"))
    )


def _merchant_losses(star: Star) -> DataFrame:
    """Failed rows and cents per merchant, with the merchant's names."""
    return _losses(star).join(star.merchants.select(*MERCHANT_NAMES), "merchant_id")


def merchant_pareto(star: Star, cut_pct: int = 80, include_crossing: bool = False) -> DataFrame:
    """Merchants by failed volume up to ``cut_pct`` percent of the whole loss.

    The cut is made on the rounded cumulative percent, so the merchant whose loss crosses it is left out;
    ``include_crossing`` keeps it. Ids and sums alone are ranked (``running_total`` writes them when this is called);
    names are joined to the merchants kept.
    """
    ranked = running_total(
        _losses(star).join(star.merchants.select("merchant_id"), "merchant_id", "left_semi"),
        order=[F.desc("loss_cents"), F.asc("merchant_id")],
        value="loss_cents",
        running="running_cents",
        position="merchant_rank",
        total="total_cents",
    ).withColumn("cumulative_loss_pct", pct(F.col("running_cents"), F.col("total_cents")))
    keep = F.col("cumulative_loss_pct") <= cut_pct
    if include_crossing:
        before = pct(F.col("running_cents") - F.col("loss_cents"), F.col("total_cents"))
        keep = keep | (before < cut_pct)
    return (
        star.merchants.select(*MERCHANT_NAMES)
        .join(ranked.where(keep), "merchant_id")
        .select(
            "merchant_rank",
            *MERCHANT_NAMES,
            "failed_txn_count",
            money("loss_cents", "merchant_lost_revenue_inr"),
            money("running_cents", "running_lost_revenue_inr"),
            "cumulative_loss_pct",
        )
        .orderBy("merchant_rank")
    )


def recoverable_gmv(star: Star) -> DataFrame:
    """Rows and cents of infrastructure failures, as a share of all FAILED volume, in one scan."""
    by_reason = (
        star.fact.groupBy("failure_reason_id")
        .agg(rows().alias("n"), cents().alias("c"), cents_where(is_failed()).alias("fc"))
        .withColumn("all_failed", F.sum("fc").over(Window.partitionBy()))
    )
    return (
        by_reason.join(star.reasons.where("failure_category = 'Infrastructure'"), "failure_reason_id")
        .groupBy("failure_reason_code", "failure_category")
        .agg(*add_up("n", "c"), F.max("all_failed").alias("all_failed"))
        .select(
            "failure_reason_code",
            "failure_category",
            F.col("n").alias("recoverable_txn_count"),
            money("c", "recoverable_gmv_inr"),
            pct(F.col("c"), F.col("all_failed")).alias("pct_of_failed_volume"),
        )
        .orderBy(F.desc("recoverable_gmv_inr"), "failure_reason_code")
    )


REASON_NAMES = ("failure_reason_code", "failure_category", "failure_reason_description")


def _leakage_by_reason(star: Star) -> DataFrame:
    by_id = (
        star.fact.where(is_leakage())
        .groupBy("failure_reason_id")
        .agg(rows().alias("n"), cents().alias("c"))
        .withColumn("all_rows", F.sum("n").over(Window.partitionBy()))
    )
    return (
        by_id.join(star.reasons, "failure_reason_id")
        .groupBy(*REASON_NAMES)
        .agg(*add_up("n", "c"), F.max("all_rows").alias("all_rows"))
    )


def failure_decomposition(star: Star) -> DataFrame:
    whole = Window.partitionBy()
    return (
        _leakage_by_reason(star)
        .select(
            *REASON_NAMES,
            F.col("n").alias("failed_txn_count"),
            money("c", "total_lost_amount_inr"),
            pct(F.col("c"), F.sum("c").over(whole)).alias("pct_share_lost_volume"),
            F.dense_rank().over(Window.orderBy(F.desc("c"))).alias("loss_rank"),
        )
        .orderBy("loss_rank", "failure_reason_code")
    )


def leakage_count_share(star: Star) -> DataFrame:
    return (
        _leakage_by_reason(star)
        .select(
            *REASON_NAMES,
            F.col("n").alias("failed_txn_count"),
            money("c", "total_lost_amount_inr"),
            pct(F.col("n"), F.col("all_rows")).alias("pct_share_failed_count"),
        )
        .orderBy(F.desc("total_lost_amount_inr"), "failure_reason_code")
    )


def _peak_hours(star: Star, month: int, method: str, city: str) -> DataFrame:
    """Attempts, failures and timeout cents per hour; the city joins rows grouped by customer and hour."""
    wanted = star.methods.where(F.col("payment_method_code") == method).select("payment_method_id")
    per_customer = (
        star.fact.where(F.month("transaction_timestamp") == month)
        .join(wanted, "payment_method_id")
        .join(star.reasons.select("failure_reason_id", "failure_reason_code"), "failure_reason_id")
        .groupBy("customer_id", txn_hour().alias("hour_of_day"))
        .agg(
            rows().alias("n"),
            rows_where(is_failed()).alias("fn"),
            cents_where_or_zero(F.col("failure_reason_code") == TIMEOUT).alias("tc"),
        )
    )
    residents = star.customers.where(F.col("city") == city).select("customer_id")
    return per_customer.join(residents, "customer_id").groupBy("hour_of_day").agg(*add_up("n", "fn", "tc"))


def _peak_report(hours: DataFrame, loss_name: str) -> DataFrame:
    return hours.select(
        "hour_of_day",
        F.col("n").alias("total_attempts"),
        F.col("fn").alias("failed_attempts"),
        pct(F.col("fn"), F.col("n")).alias("failure_rate_pct"),
        money("tc", loss_name),
    ).orderBy("hour_of_day")


def peak_hour_anomaly(star: Star, month: int = 7, method: str = "upi", city: str = "Tier-2 Cities") -> DataFrame:
    return _peak_report(_peak_hours(star, month, method, city), "gateway_timeout_lost_revenue_inr")


def peak_hour_anomaly_zero(
    star: Star, month: int = 7, method: str = "upi", city: str = "Tier-2 Cities"
) -> DataFrame:
    """The template form of the peak-hour report; its sums are 0 by an ELSE branch, with the same values."""
    return _peak_report(_peak_hours(star, month, method, city), "gateway_timeout_lost_inr")


CUSTOMER_NAMES = ("customer_id", "customer_name", "customer_segment", "city")


def _customer_totals(star: Star) -> DataFrame:
    return star.fact.groupBy("customer_id").agg(
        rows().alias("n"), cents().alias("c"), rows_where(is_failed()).alias("fn")
    )


def churn_risk_tiers(
    star: Star,
    min_spend: int = 25000,
    min_rate: int = 20,
    tiers: Sequence[tuple[int, int]] = ((50000, 30), (35000, 25)),
) -> DataFrame:
    """Customers above ``min_spend`` whose rounded failure percent is at least ``min_rate``."""
    rate = F.col("failure_rate_pct")
    tier = F.lit(TIER_NAMES[-1])
    for name, (spend, floor) in reversed(list(zip(TIER_NAMES, tiers))):
        tier = F.when((F.col("c") >= spend * 100) & (rate >= floor), name).otherwise(tier)
    at_risk = (
        _customer_totals(star)
        .where(F.col("c") > min_spend * 100)
        .withColumn("failure_rate_pct", pct(F.col("fn"), F.col("n")))
        .where(rate >= min_rate)
    )
    return (
        at_risk.join(star.customers.select(*CUSTOMER_NAMES), "customer_id")
        .select(
            *CUSTOMER_NAMES,
            money("c", "total_attempted_spend_inr"),
            F.col("n").alias("total_attempts"),
            F.col("fn").alias("failed_txns"),
            "failure_rate_pct",
            tier.alias("risk_tier"),
        )
        .orderBy(F.desc("total_attempted_spend_inr"), F.desc("failure_rate_pct"), "customer_id")
    )


def at_risk_customers_having(
    star: Star, min_spend: int = 25000, min_rate: int = 20, top: int | None = 15
) -> DataFrame:
    """Customers at or above ``min_spend`` whose unrounded failure percent is at least ``min_rate``."""
    at_risk = _customer_totals(star).where(
        (F.col("c") >= min_spend * 100) & (F.col("fn") * 100 >= F.col("n") * min_rate)
    )
    out = (
        at_risk.join(star.customers.select(*CUSTOMER_NAMES), "customer_id")
        .select(
            *CUSTOMER_NAMES,
            money("c", "total_attempted_spend_inr"),
            F.col("n").alias("total_attempts"),
            F.col("fn").alias("failed_attempts"),
            pct(F.col("fn"), F.col("n")).alias("failure_rate_pct"),
        )
        .orderBy(F.desc("total_attempted_spend_inr"), "customer_id")
    )
    return out if top is None else out.limit(top)


def gateway_sla(star: Star) -> DataFrame:
    by_ids = star.fact.groupBy("gateway", "payment_method_id", "failure_reason_id").agg(
        rows().alias("n"),
        cents().alias("c"),
        rows_where(status_is("SUCCESS")).alias("sn"),
        cents_where(is_failed()).alias("fc"),
    )

    def rows_of(code: str) -> Column:
        return F.sum(F.when(F.col("failure_reason_code") == code, F.col("n")).otherwise(0))

    return (
        by_ids.join(star.methods, "payment_method_id")
        .join(star.reasons, "failure_reason_id")
        .groupBy("gateway", "payment_method_name")
        .agg(
            *add_up("n", "c", "sn", "fc"),
            rows_of(TIMEOUT).alias("gateway_timeout_count"),
            rows_of(TECH_ERROR).alias("technical_error_count"),
        )
        .select(
            "gateway",
            "payment_method_name",
            F.col("n").alias("total_transactions"),
            money("c", "total_processing_volume_inr"),
            pct(F.col("sn"), F.col("n")).alias("success_rate_pct"),
            "gateway_timeout_count",
            "technical_error_count",
            to_money(F.coalesce(F.col("fc"), F.lit(0))).alias("total_financial_volume_lost_inr"),
        )
        .orderBy(F.desc("total_financial_volume_lost_inr"), "gateway", "payment_method_name")
    )


def status_summary_shares(star: Star) -> DataFrame:
    whole = Window.partitionBy()
    return (
        star.fact.groupBy("transaction_status")
        .agg(
            rows().alias("n"),
            cents().alias("c"),
            priced().alias("cn"),
            F.sum(risk_tenths()).alias("r"),
            F.count("risk_score").alias("rn"),
        )
        .select(
            "transaction_status",
            F.col("n").alias("transaction_count"),
            pct(F.col("n"), F.sum("n").over(whole)).alias("count_pct"),
            money("c", "total_volume_inr"),
            pct(F.col("c"), F.sum("c").over(whole)).alias("volume_pct"),
            avg_money(F.col("c"), F.col("cn")).alias("avg_ticket_size"),
            avg_tenths(F.col("r"), F.col("rn")).alias("avg_risk_score"),
        )
        .orderBy(F.desc("transaction_count"), "transaction_status")
    )


def status_volume(star: Star) -> DataFrame:
    return (
        star.fact.groupBy("transaction_status")
        .agg(rows().alias("transaction_count"), cents().alias("c"), priced().alias("cn"))
        .select(
            "transaction_status",
            "transaction_count",
            money("c", "total_volume_inr"),
            avg_money(F.col("c"), F.col("cn")).alias("avg_ticket_size"),
        )
        .orderBy(F.desc("total_volume_inr"), "transaction_status")
    )


def top_failure_reasons(star: Star, n: int = 5) -> DataFrame:
    """The reasons with the largest lost volume; shares are of all reasons, before the cut to ``n``."""
    lost = F.col("transaction_status").isin("FAILED", "FRAUD_BLOCKED") | is_leakage()
    by_id = star.fact.where(lost).groupBy("failure_reason_id").agg(rows().alias("n"), cents().alias("c"), priced().alias("cn"))
    return (
        by_id.join(star.reasons, "failure_reason_id")
        .select(
            "failure_reason_id",
            "failure_reason_code",
            "failure_category",
            F.col("n").alias("failed_txns_count"),
            money("c", "lost_volume_inr"),
            pct(F.col("c"), F.sum("c").over(Window.partitionBy())).alias("pct_of_failed_volume"),
            avg_money(F.col("c"), F.col("cn")).alias("avg_lost_ticket_size"),
        )
        .orderBy(F.desc("lost_volume_inr"), "failure_reason_id")
        .limit(n)
    )


def top_merchants_by_loss(star: Star, n: int = 10) -> DataFrame:
    return (
        _merchant_losses(star)
        .select(*MERCHANT_NAMES, "failed_txn_count", money("loss_cents", "total_lost_revenue_inr"))
        .orderBy(F.desc("total_lost_revenue_inr"), "merchant_id")
        .limit(n)
    )


def city_gateway_failures(star: Star, city: str = "Tier-2 Cities") -> DataFrame:
    per_customer = (
        star.fact.join(star.reasons.select("failure_reason_id", "failure_reason_code"), "failure_reason_id")
        .groupBy("customer_id", "gateway")
        .agg(
            rows().alias("n"),
            rows_where(is_failed()).alias("fn"),
            rows_where(F.col("failure_reason_code") == TIMEOUT).alias("tn"),
            cents_where_or_zero(is_failed()).alias("fc"),
        )
    )
    residents = star.customers.where(F.col("city") == city).select("customer_id")
    return (
        per_customer.join(residents, "customer_id")
        .groupBy("gateway")
        .agg(*add_up("n", "fn", "tn", "fc"))
        .select(
            "gateway",
            F.col("n").alias("total_attempts"),
            F.col("fn").alias("failed_attempts"),
            pct(F.col("fn"), F.col("n")).alias("failure_rate_pct"),
            F.col("tn").alias("timeout_count"),
            money("fc", "lost_volume_inr"),
        )
        .orderBy(F.desc("failure_rate_pct"), "gateway")
    )


def offhours_high_ticket_list(
    star: Star, first_hour: int = 0, last_hour: int = 5, min_amount: int = 5000, top: int = 20
) -> DataFrame:
    """The largest fraud rows above ``min_amount`` in the off hours; ties are broken by all columns."""
    return (
        star.fact.where(
            (F.col("is_fraud") == 1)
            & (F.col("amount_cents") > min_amount * 100)
            & in_hours(first_hour, last_hour)
        )
        .join(star.methods.select("payment_method_id", "payment_method_name"), "payment_method_id")
        .select(
            "transaction_id",
            "transaction_timestamp",
            F.col("amount").alias("transaction_amount_inr"),
            "gateway",
            "payment_method_name",
            "risk_score",
            "device_type",
        )
        .orderBy(
            F.desc("transaction_amount_inr"),
            "transaction_id",
            "transaction_timestamp",
            "gateway",
            "payment_method_name",
            "risk_score",
            "device_type",
        )
        .limit(top)
    )
