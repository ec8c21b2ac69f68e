"""Headline numbers of a report, as one-row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tillscope.functions.exact import half_up, to_cents

MONEY = "decimal(20,2)"


def _total(name: str) -> Column:
    return F.sum(name).cast(MONEY)


def _leader(value: str, order: str, key: str) -> Column:
    """``value`` on the row with the largest ``order``; among equals, the smallest ``key``."""
    return F.max_by(F.col(value), F.struct(F.col(order), -F.col(key)))


def top_share(reasons: DataFrame) -> DataFrame:
    """Leading failure reason, its loss, and its percent (one decimal) of the summed loss."""
    loss, code = F.col("total_lost_amount_inr"), F.col("failure_reason_code")
    return reasons.agg(
        F.min_by(code, F.struct(-loss, code)).alias("top_reason"),
        F.max(loss).alias("top_amount_inr"),
        _total("total_lost_amount_inr").alias("total_loss_inr"),
    ).withColumn(
        "top_pct",
        (
            F.coalesce(
                half_up(to_cents(F.col("top_amount_inr")), to_cents(F.col("total_loss_inr")), 1000).cast("decimal(20,0)"),
                F.when(F.col("total_loss_inr") == 0, F.lit(0).cast("decimal(20,0)")),
            )
            / 10
        ).cast("decimal(20,1)"),
    )


def top_merchants(merchants: DataFrame) -> DataFrame:
    """Number and summed loss of the listed merchants, and the leading one."""
    loss = "total_lost_revenue_inr"
    return merchants.agg(
        F.count("*").alias("merchants"),
        _total(loss).alias("listed_loss_inr"),
        _leader("merchant_name", loss, "merchant_id").alias("top_merchant"),
        _leader("merchant_category", loss, "merchant_id").alias("top_category"),
        F.max(loss).alias("top_loss_inr"),
    )


def worst_gateway(gateways: DataFrame) -> DataFrame:
    """The gateway with the largest value in the report's last column."""
    last = gateways.columns[-1]
    return (
        gateways.orderBy(F.desc(last), "gateway")
        .limit(1)
        .select(F.col("gateway").alias("worst_gateway"), F.col(last).alias("worst_value"))
    )


def at_risk_total(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count("*").alias("customers"), _total("total_attempted_spend_inr").alias("total_at_risk_spend_inr")
    )


def macro(kpis: DataFrame) -> DataFrame:
    return kpis.select("total_gmv_inr", "success_rate_pct", "revenue_at_risk_inr", "fraud_blocked_inr")


def default(df: DataFrame) -> DataFrame:
    """Rows, and sum and mean of the first numeric column; for any report."""
    first = next(f for f in df.schema if isinstance(f.dataType, NumericType))
    total = F.sum(first.name).cast("double")
    return df.agg(
        F.lit(first.name).alias("main_column"),
        F.count("*").alias("records"),
        total.alias("total_value"),
        F.try_divide(total, F.count(first.name).cast("double")).alias("avg_value"),
    )
