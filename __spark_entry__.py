"""Entry points: the flagship query, all registered queries and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StringType, TimestampNTZType

from tillscope.functions.exact import significant
from tillscope.operators import etl, profile, quality, stats
from tillscope.plans import digests, measures, reports, suite
from tillscope.schemas import RAW_FEED, STATUSES, TABLES
from tillscope.session import fresh_path
from tillscope.sources import orderlines, tables
from tillscope.star import Star, is_failed

Query = Callable[[SparkSession, str], DataFrame]

SMALL = "/root/testdata/sf0.001"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps as text, the types both engines print alike."""
    if not any(isinstance(f.dataType, (DecimalType, TimestampNTZType)) for f in df.schema):
        return df

    def shown(field):
        if isinstance(field.dataType, DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        if isinstance(field.dataType, TimestampNTZType):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[shown(f) for f in df.schema])


def on_star(report: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(report(orderlines.star_view(spark, sf_dir)))


def on_raw(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(step(orderlines.raw_feed(spark, sf_dir)))


# Scans, sinks, loads and audits


def drifted_feed(raw: DataFrame) -> str:
    """The whole feed exported as CSV, with a band that turns to text on some rows."""
    band = F.when(F.col("transaction_id") % 1000 == 1, F.lit("band A")).otherwise(F.col("credit_score_band").cast("string"))
    return tables.export_csv(raw.withColumn("credit_score_band", band), fresh_path(raw.sparkSession, "feed"))


def scan_csv_inferred(raw: DataFrame) -> DataFrame:
    found = tables.scan_csv_inferred(raw.sparkSession, drifted_feed(raw))
    return found.withColumn("transaction_time", F.col("transaction_time").cast("string"))


def schema_drift(raw: DataFrame) -> DataFrame:
    return tables.schema_drift(raw.sparkSession, drifted_feed(raw), RAW_FEED)


def scan_csv_typed(star: Star) -> DataFrame:
    spark = star.fact.sparkSession
    path = tables.export_csv(star.table("fact_transactions").select(*TABLES["fact_transactions"].names), fresh_path(spark, "fact"))
    return tables.scan_csv(spark, path, TABLES["fact_transactions"].schema)


def scan_column_subset(star: Star) -> DataFrame:
    spark = star.fact.sparkSession
    path = fresh_path(spark, "customers")
    star.customers.write.parquet(path)
    return tables.scan_columns(spark, path, ["customer_id", "city"])


def inline_dims(star: Star) -> DataFrame:
    """The literal dimensions, with the fact rows of each member."""
    methods = star.methods.select(
        F.lit("payment_method").alias("dimension"),
        F.col("payment_method_id").alias("id"),
        F.col("payment_method_code").alias("code"),
        F.col("payment_method_name").alias("label"),
        F.col("category_type").alias("category"),
    )
    reasons = star.reasons.select(
        F.lit("failure_reason").alias("dimension"),
        F.col("failure_reason_id").alias("id"),
        F.col("failure_reason_code").alias("code"),
        F.col("failure_reason_description").alias("label"),
        F.col("failure_category").alias("category"),
    )
    used = (
        star.fact.groupBy("payment_method_id", "failure_reason_id")
        .agg(F.count("*").alias("n"))
        .select(
            F.inline(
                F.array(
                    F.struct(F.lit("payment_method").alias("dimension"), F.col("payment_method_id").alias("id"), "n"),
                    F.struct(F.lit("failure_reason").alias("dimension"), F.col("failure_reason_id").alias("id"), "n"),
                )
            )
        )
        .groupBy("dimension", "id")
        .agg(F.sum("n").alias("fact_rows"))
    )
    return methods.unionByName(reasons).join(used, ["dimension", "id"], "left").na.fill(0, ["fact_rows"])


def create_or_replace_table(star: Star) -> DataFrame:
    """A table made from the merchants of one city, then fully refreshed from all merchants."""
    name = f"merchants_{uuid.uuid4().hex[:12]}"
    tables.replace_table(star.merchants.where("city = 'Mumbai'"), name)
    return tables.replace_table(star.merchants, name)


def export_and_read(star: Star) -> DataFrame:
    """All five tables exported and read back: rows, sum of the key and characters of the texts of each."""
    spark = star.fact.sparkSession
    folder = fresh_path(spark, "csv")
    tables.export_star_csv(star, folder)
    loaded = tables.load_star_csv(spark, folder).tables()

    def read(name: str, df: DataFrame) -> DataFrame:
        texts = [F.sum(F.length(f.name)) for f in df.schema if isinstance(f.dataType, StringType)]
        return df.agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("exported_rows"),
            F.sum(TABLES[name].names[0]).cast("bigint").alias("key_sum"),
            sum(texts, F.lit(0)).cast("bigint").alias("text_chars"),
        )

    return quality.union_all([read(name, df) for name, df in loaded.items()])


def table_preview(star: Star) -> DataFrame:
    return tables.preview(star.table("fact_transactions").select(*TABLES["fact_transactions"].names), 5, ["transaction_id"])


def load_reconciliation(star: Star) -> DataFrame:
    spark = star.fact.sparkSession
    folder = fresh_path(spark, "csv")
    tables.export_star_csv(star, folder)
    loaded = tables.load_star_csv(spark, folder)
    return quality.reconcile(quality.csv_line_counts(spark, folder), quality.row_counts(loaded))


def domain_audit(star: Star) -> DataFrame:
    """The exported text of all tables, with amounts too large, scores that are no numbers or have too many places, and a long device."""
    spark = star.fact.sparkSession
    texts = {name: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for name, df in star.tables().items()}
    tid = F.col("transaction_id").cast("bigint")
    planted = {
        "amount": F.when(tid % 1000 == 1, "99999999999.99").when(tid % 1000 == 2, "1e3x").otherwise(F.col("amount")),
        "risk_score": F.when(tid % 500 == 3, "12.345").when(tid % 500 == 4, "12.300").otherwise(F.col("risk_score")),
        "device_type": F.when(tid % 2000 == 5, F.repeat(F.lit("x"), F.lit(51))).otherwise(F.col("device_type")),
        "is_fraud": F.when(tid % 1000 == 6, "yes").otherwise(F.col("is_fraud")),
    }
    texts["fact_transactions"] = texts["fact_transactions"].withColumns(planted)
    folder = fresh_path(spark, "text")
    read = {name: tables.scan_csv_text(spark, tables.export_csv(df, f"{folder}/{name}")) for name, df in texts.items()}
    return quality.domain_audit(read)


def default_fill(star: Star) -> DataFrame:
    """Flags removed on some rows, then filled by the defaults."""
    gaps = star.fact.withColumns(
        {
            "is_international": F.when(F.col("transaction_id") % 3 != 0, F.col("is_international")),
            "is_fraud": F.when(F.col("transaction_id") % 5 != 0, F.col("is_fraud")),
            "failed_txn_count_24h": F.when(F.col("transaction_id") % 7 != 0, F.col("failed_txn_count_24h")),
        }
    )
    return quality.default_fill(gaps).select(
        "transaction_id", "is_international", "is_fraud", "failed_txn_count_24h"
    )


def layout_for_lookup(star: Star) -> DataFrame:
    """The fact stored for lookups and summed per month and status from there."""
    spark = star.fact.sparkSession
    path = tables.write_layout(star.fact, fresh_path(spark, "fact"))
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("txn_month").cast("string").alias("txn_month"), "transaction_status").agg(
        F.count("*").alias("transaction_count"),
        (F.sum("amount_cents").cast("double") / 100.0).alias("total_volume_inr"),
    )


LOADS = {
    "scan_csv_typed": scan_csv_typed,
    "scan_column_subset": scan_column_subset,
    "inline_dims": inline_dims,
    "create_or_replace_table": create_or_replace_table,
    "export_csv": export_and_read,
    "table_preview": table_preview,
    "schema_catalog": tables.schema_catalog,
    "row_count_audit": quality.row_counts,
    "load_reconciliation": load_reconciliation,
    "pk_audit": quality.pk_audit,
    "not_null_audit": quality.not_null_audit,
    "fk_orphan_audit": quality.fk_orphan_audit,
    "domain_audit": domain_audit,
    "default_fill": default_fill,
    "layout_for_lookup": layout_for_lookup,
}


# From the raw feed to the star


def surrogate_labels(raw: DataFrame) -> DataFrame:
    return raw.groupBy("customer_id").agg(F.count("*").alias("feed_rows")).select(
        "customer_id", etl.label("Customer", "customer_id").alias("customer_name"), "feed_rows"
    )


def hash_bucket_assign(raw: DataFrame) -> DataFrame:
    drawn = etl.assign(raw, "transaction_id", "transaction", gateway=etl.split(etl.schemas.GATEWAYS))
    return drawn.select("transaction_id", "gateway")


def lookup_map(star: Star) -> DataFrame:
    """State by city, with a city the map does not know on every seventh customer."""
    city = F.when(F.col("customer_id") % 7 == 0, F.lit("Elsewhere")).otherwise(F.col("city"))
    return star.customers.select("customer_id", city.alias("city")).withColumn(
        "state", etl.lookup(F.col("city"), etl.CITY_STATE)
    )


def round_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        "transaction_id",
        etl.round_to("transaction_amount", 2).alias("amount"),
        etl.round_to("avg_monthly_spend", 2).alias("avg_monthly_spend"),
        etl.round_to("merchant_risk_score", 4, 6).alias("merchant_risk_score"),
    )


def channel_to_id(raw: DataFrame) -> DataFrame:
    """Method id by channel, with a channel nobody knows on every eleventh row."""
    channel = F.when(F.col("transaction_id") % 11 == 0, F.lit("cheque")).otherwise(F.col("payment_channel"))
    odd = raw.select("transaction_id", channel.alias("payment_channel"))
    return etl.channel_to_id(odd, etl.payment_methods(raw.sparkSession))


def timestamp_to_seconds(raw: DataFrame) -> DataFrame:
    return raw.select("transaction_id", etl.seconds_text("transaction_time").alias("transaction_timestamp"))


def capitalize_device(raw: DataFrame) -> DataFrame:
    return raw.select("transaction_id", etl.capitalize("device_type").alias("device_type"))


def scale_risk_score(raw: DataFrame) -> DataFrame:
    return raw.select("transaction_id", etl.scale_risk("post_auth_risk_score").alias("risk_score"))


def status_rule_cascade(raw: DataFrame) -> DataFrame:
    return etl.label_status(etl.mark_peak(raw)).select(
        "transaction_id", "customer_id", "merchant_id", "is_peak", "transaction_status", "failure_reason_id"
    )


def fact_project(raw: DataFrame) -> DataFrame:
    return etl.build_fact(raw, None, etl.payment_methods(raw.sparkSession))


def with_repeats(raw: DataFrame) -> DataFrame:
    """The whole feed with every fiftieth transaction in it twice, so that there are duplicates to find."""
    return raw.unionByName(raw.where("transaction_id % 50 = 0"))


def with_long_ids(raw: DataFrame) -> DataFrame:
    """The feed with a reference of 19 digits, which a double does not hold."""
    return raw.withColumn("network_reference", F.lit(1_234_567_890_123_456_000) + F.col("transaction_id"))


RAW_STEPS = {
    "scan_csv_inferred": scan_csv_inferred,
    "schema_drift": schema_drift,
    "dim_customers_build": etl.build_customers,
    "surrogate_labels": surrogate_labels,
    "hash_bucket_assign": hash_bucket_assign,
    "dim_merchants_build": etl.build_merchants,
    "round_columns": round_columns,
    "channel_to_id": channel_to_id,
    "timestamp_to_seconds": timestamp_to_seconds,
    "capitalize_device": capitalize_device,
    "scale_risk_score": scale_risk_score,
    "status_rule_cascade": status_rule_cascade,
    "fact_project": fact_project,
    "profile_shape": profile.shape,
    "profile_nulls": profile.nulls,
    "profile_duplicates": lambda raw: profile.duplicates(with_repeats(raw)),
    "profile_column_roles": profile.roles,
    "profile_timestamps": profile.timestamps,
    "profile_categories": profile.categories,
    "profile_numeric": lambda raw: profile.numbers(with_long_ids(raw)),
    "profile_report": profile.report,
}

STAR_STEPS = {
    "lookup_map": lookup_map,
    "status_distribution": etl.status_distribution,
    "reason_distribution": etl.reason_distribution,
    "scenario_verification": etl.scenario_verification,
}


# Reports

CHANNEL_SQL = """
SELECT m.payment_method_name, t.is_international, count(*) AS attempts,
       count(CASE WHEN t.transaction_status = 'FAILED' THEN 1 END) AS failed_attempts,
       max(t.failed_txn_count_24h) AS most_failures_24h
FROM fact_transactions t JOIN dim_payment_methods m ON t.payment_method_id = m.payment_method_id
GROUP BY m.payment_method_name, t.is_international
ORDER BY attempts DESC;
"""


def run_sql(star: Star) -> DataFrame:
    return suite.run_sql(star.fact.sparkSession, star, CHANNEL_SQL)


def report_catalog(star: Star) -> DataFrame:
    return suite.run_suite(star, fresh_path(star.fact.sparkSession, "suite"), store=False).drop("error")


REPORTS = {
    "macro_kpis": reports.macro_kpis,
    "channel_performance": reports.channel_performance,
    "segment_matrix": reports.segment_matrix,
    "offhours_fraud": reports.offhours_fraud,
    "offhours_surge_ratio": reports.offhours_surge_ratio,
    "corridor_risk": reports.corridor_risk,
    "category_fraud": reports.category_fraud,
    "merchant_pareto": reports.merchant_pareto,
    "recoverable_gmv": reports.recoverable_gmv,
    "failure_decomposition": reports.failure_decomposition,
    "peak_hour_anomaly": reports.peak_hour_anomaly,
    "churn_risk_tiers": reports.churn_risk_tiers,
    "gateway_sla": reports.gateway_sla,
    "status_summary_shares": reports.status_summary_shares,
    "top_failure_reasons": reports.top_failure_reasons,
    "top_merchants_by_loss": reports.top_merchants_by_loss,
    "city_gateway_failures": reports.city_gateway_failures,
    "offhours_high_ticket_list": reports.offhours_high_ticket_list,
    "leakage_count_share": reports.leakage_count_share,
    "peak_hour_anomaly_zero": reports.peak_hour_anomaly_zero,
    "at_risk_customers_having": reports.at_risk_customers_having,
    "macro_kpis_case": reports.macro_kpis_zero,
    "status_volume": reports.status_volume,
    "run_sql": run_sql,
    "report_catalog": report_catalog,
}


# Measures

MEASURES = {
    "measures_core": lambda s: measures.evaluate(s, measures.CORE, ["payment_method_code"]),
    "measures_leakage": lambda s: measures.evaluate(s, measures.LEAKAGE),
    "measures_customer_merchant": lambda s: measures.evaluate(s, measures.CUSTOMER_MERCHANT),
    "measures_gateway_fraud": lambda s: measures.evaluate(s, measures.GATEWAY_FRAUD, ["gateway"]),
    "measure_by_dims": lambda s: measures.evaluate_with_totals(
        s,
        ["Total Gross Volume GMV", "Total Transactions", "Failure Rate %", "Infrastructure Lost Revenue", "at_risk_customers"],
        ["customer_segment", "payment_method_code"],
        {"txn_month": measures.equals(7)},
    ),
    "measure_filter_override": lambda s: measures.evaluate(
        s,
        ["total_gross_volume_gmv", "successful_volume", "total_transactions", "failed_transactions", "failure_rate"],
        ["transaction_status", "gateway"],
    ),
    "measure_all_denominator": lambda s: measures.evaluate(
        s, ["revenue_at_risk_failed", "top_20_merchant_loss_share"], ["merchant_category"]
    ),
    "measure_entity_filter": lambda s: measures.evaluate(
        s,
        [
            "total_customers",
            "high_spend_customers",
            "at_risk_customers",
            "at_risk_customer_spend",
            "at_risk_customer_spend_share",
        ],
        ["customer_segment"],
    ),
}


# Statistics


def gateway_counts(star: Star) -> DataFrame:
    """Failures of every gateway and method against all others, fraud rows left out."""
    return stats.segment_counts(star.fact.where("is_fraud = 0"), ["gateway", "payment_method_id"], is_failed())


def method_table(star: Star, margins: bool = False) -> DataFrame:
    return stats.crosstab(
        stats.method_outcomes(star), "payment_method_name", "transaction_status", STATUSES, "n", margins=margins
    )


def expected_frequencies(star: Star) -> DataFrame:
    return stats.expected_frequencies(method_table(star), STATUSES)


def chi_squares(star: Star) -> DataFrame:
    """Independence of method and outcome: failed or not, all statuses, and statuses within each gateway."""
    outcomes = stats.method_outcomes(star)
    binary = ("FAILED", "NON_FAILED")
    failed = stats.crosstab(outcomes, "payment_method_name", "is_failed", binary, "n")
    status = stats.crosstab(outcomes, "payment_method_name", "transaction_status", STATUSES, "n")
    gateways = stats.crosstab(star.fact, "payment_method_id", "transaction_status", STATUSES, by=["gateway"])
    tests = [
        stats.chi_square(failed, binary).withColumn("test", F.lit("failed by method")),
        stats.chi_square(status, STATUSES).withColumn("test", F.lit("status by method")),
        stats.chi_square(gateways, STATUSES, ["gateway"])
        .withColumn("test", F.concat(F.lit("status by method at "), "gateway"))
        .drop("gateway"),
    ]
    return quality.union_all(tests).select("test", "n", "chi2", "dof")


def to_six(df: DataFrame, *names: str) -> DataFrame:
    """Tail probabilities to six significant digits; the two engines' exponentials differ in the last bits."""
    return df.withColumns({n: significant(F.col(n)) for n in names})


def z_p_values(star: Star) -> DataFrame:
    tested = stats.z_p_values(stats.two_proportion_z(gateway_counts(star)))
    shown = tested.select("gateway", "payment_method_id", "z", "p_one_tailed", "p_two_tailed", "decision")
    return to_six(shown, "p_one_tailed", "p_two_tailed")


STATISTICS = {
    "two_sample_counts": stats.peak_counts,
    "two_proportion_z": lambda s: stats.two_proportion_z(gateway_counts(s)),
    "z_p_values": z_p_values,
    "effect_sizes": lambda s: stats.effect_sizes(stats.two_proportion_z(gateway_counts(s))),
    "diff_confidence_interval": lambda s: stats.diff_confidence_interval(stats.two_proportion_z(gateway_counts(s))),
    "crosstab": method_table,
    "crosstab_margins": lambda s: method_table(s, margins=True),
    "expected_frequencies": expected_frequencies,
    "chi_square_independence": chi_squares,
    "chi_square_p_value": lambda s: to_six(stats.chi_square_p_value(chi_squares(s)), "p_value"),
}


# Digests

DIGESTS = {
    "digest_top_share": lambda s: digests.top_share(reports.leakage_count_share(s)),
    "digest_top_merchants": lambda s: digests.top_merchants(reports.top_merchants_by_loss(s)),
    "digest_worst_gateway": lambda s: digests.worst_gateway(reports.city_gateway_failures(s)),
    "digest_at_risk_total": lambda s: digests.at_risk_total(reports.at_risk_customers_having(s)),
    "digest_default": lambda s: digests.default(reports.status_volume(s)),
    "digest_macro": lambda s: digests.macro(reports.macro_kpis_zero(s)),
}


def entry(spark: SparkSession) -> DataFrame:
    return queries()["merchant_pareto"](spark, SMALL)


def training_data():
    """The queries of the training-data operators, or None where that subpackage is not there."""
    try:
        import tillscope.llm.queries as found
    except ModuleNotFoundError as missing:
        if (missing.name or "").startswith("tillscope.") and not missing.name.startswith("tillscope.llm"):
            raise  # a part of the analytics, which must be there
        return None
    return found


def queries() -> dict[str, Query]:
    return analytics() | (found.queries() if (found := training_data()) else {})


def analytics() -> dict[str, Query]:
    on_stars = {**LOADS, **STAR_STEPS, **REPORTS, **MEASURES, **STATISTICS, **DIGESTS}
    return {name: on_star(q) for name, q in on_stars.items()} | {name: on_raw(q) for name, q in RAW_STEPS.items()}


def oracle_sql() -> dict[str, str]:
    from oracles import all_sql

    return all_sql() | (found.oracle_sql() if (found := training_data()) else {})
