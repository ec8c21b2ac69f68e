"""Oracles of scans, sinks, loads and audits."""

from pyspark.sql.types import StringType

from oracles.star import money, star
from tillscope.schemas import TABLES

# How the CTEs hold the decimal columns: as integers of the last place.
UNITS = {
    ("dim_customers", "avg_monthly_spend"): "spend_cents",
    ("fact_transactions", "amount"): "cents",
    ("fact_transactions", "risk_score"): "risk_tenths",
    ("dim_merchants", "merchant_risk_score"): "CAST(round(merchant_risk_score * 10000) AS BIGINT)",
}

FACT_COLUMNS = f"""transaction_id, customer_id, merchant_id, payment_method_id, failure_reason_id,
  strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S') AS transaction_timestamp, {money('cents')} AS amount,
  device_type, gateway, CAST(risk_tenths AS DOUBLE) / 10 AS risk_score, transaction_status, is_international,
  is_fraud, failed_txn_count_24h"""
CUSTOMER_COLUMNS = """customer_id, customer_name, customer_segment, city, state, account_age_days,
  credit_score_band, kyc_level, avg_monthly_spend"""
MERCHANT_COLUMNS = "merchant_id, merchant_name, merchant_category, city, state, merchant_risk_score"


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def counts() -> str:
    return union(f"SELECT '{t}' AS table_name, count(*) AS loaded_rows FROM {t}" for t in TABLES)


def not_null() -> str:
    return union(
        f"SELECT '{t.name}' AS table_name, '{c.name}' AS column_name, 'NOT NULL' AS check_name,"
        f" count(*) FILTER (WHERE {UNITS.get((t.name, c.name), c.name)} IS NULL) AS bad_rows FROM {t.name}"
        for t in TABLES.values()
        for c in t.columns
        if c.required
    )


# Values planted in the exported text of the fact: column and check, rows that fail it.
PLANTED = {
    ("amount", "NUMERIC"): "transaction_id % 1000 IN (1, 2)",
    ("risk_score", "SCALE"): "transaction_id % 500 = 3",
    ("device_type", "LENGTH"): "transaction_id % 2000 = 5",
    ("is_fraud", "INT"): "transaction_id % 1000 = 6",
}


def domains() -> str:
    parts = []
    for t in TABLES.values():
        for c in t.columns:
            kind = c.type.simpleString().upper()
            if c.max_length:
                checks = {f"LENGTH <= {c.max_length}": f"length({c.name}) > {c.max_length}"}
            elif c.type.typeName() == "decimal":
                whole = f"abs({UNITS[t.name, c.name]}) >= 10::HUGEINT ** {c.type.precision}"
                checks = {f"NUMERIC({c.type.precision},{c.type.scale})": whole, f"SCALE <= {c.type.scale}": "false"}
            else:
                checks = {kind: "false"}
            for check, bad in checks.items():
                planted = PLANTED.get((c.name, check.split("(")[0].split(" ")[0])) if t.name == "fact_transactions" else None
                parts.append(
                    f"SELECT '{t.name}' AS table_name, '{c.name}' AS column_name, '{check}' AS check_name,"
                    f" count(*) FILTER (WHERE {planted or bad}) AS bad_rows FROM {t.name}"
                )
    return union(parts)


def with_status(checks: str) -> str:
    return f""", checks AS ({checks})
SELECT *, CASE WHEN bad_rows = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM checks"""


def keys() -> str:
    return union(
        f"""SELECT '{t.name}' AS table_name, '{t.key}' AS column_name,
  CAST(coalesce(sum(n) FILTER (WHERE {t.key} IS NULL), 0) AS BIGINT) AS null_keys,
  count(*) FILTER (WHERE {t.key} IS NOT NULL AND n > 1) AS duplicate_keys,
  CAST(coalesce(sum(n - 1) FILTER (WHERE {t.key} IS NOT NULL), 0) AS BIGINT) AS excess_rows,
  CASE WHEN count(*) FILTER (WHERE {t.key} IS NULL OR n > 1) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
  FROM (SELECT {t.key}, count(*) AS n FROM {t.name} GROUP BY {t.key}) g"""
        for t in TABLES.values()
    )


def catalog() -> str:
    return union(
        f"SELECT '{t.name}' AS table_name, (SELECT count(*) FROM {t.name}) AS total_rows, {i + 1} AS position,"
        f" '{c.name}' AS column_name, '{c.type.simpleString()}' AS data_type"
        for t in TABLES.values()
        for i, c in enumerate(t.columns)
    )


def exported() -> str:
    """Rows, key sum and text length of each table."""
    parts = []
    for name, table in TABLES.items():
        chars = " + ".join(f"sum(length({c.name}))" for c in table.columns if isinstance(c.type, StringType))
        parts.append(
            f"SELECT '{name}' AS table_name, count(*) AS exported_rows, CAST(sum({table.names[0]}) AS BIGINT) AS key_sum,"
            f" CAST({chars} AS BIGINT) AS text_chars FROM {name}"
        )
    return "\nUNION ALL ".join(parts)


BODIES = {
    "scan_csv_typed": f"SELECT {FACT_COLUMNS} FROM fact_transactions",
    "scan_column_subset": "SELECT customer_id, city FROM dim_customers",
    "inline_dims": """SELECT 'payment_method' AS dimension, payment_method_id AS id, payment_method_code AS code,
  payment_method_name AS label, category_type AS category,
  (SELECT count(*) FROM fact_transactions f WHERE f.payment_method_id = m.payment_method_id) AS fact_rows
  FROM dim_payment_methods m
UNION ALL SELECT 'failure_reason', failure_reason_id, failure_reason_code, failure_reason_description,
  failure_category,
  (SELECT count(*) FROM fact_transactions f WHERE f.failure_reason_id = r.failure_reason_id)
  FROM dim_failure_reasons r""",
    "create_or_replace_table": f"SELECT {MERCHANT_COLUMNS} FROM dim_merchants",
    "export_csv": exported(),
    "table_preview": f"""SELECT {FACT_COLUMNS} FROM fact_transactions
  ORDER BY ALL NULLS FIRST LIMIT 5""",
    "schema_catalog": catalog(),
    "row_count_audit": counts(),
    "load_reconciliation": f""", c AS ({counts()})
SELECT table_name, loaded_rows AS source_rows, loaded_rows, 'MATCH (OK)' AS status, 'PASSED' AS overall_status FROM c""",
    "pk_audit": keys(),
    "not_null_audit": with_status(not_null()),
    "domain_audit": with_status(domains()),
    "fk_orphan_audit": """SELECT count(transaction_id) AS total_fact_records,
  count(transaction_id) FILTER (WHERE c.customer_id IS NULL) AS orphan_customers,
  count(transaction_id) FILTER (WHERE m.merchant_id IS NULL) AS orphan_merchants,
  count(transaction_id) FILTER (WHERE p.payment_method_id IS NULL) AS orphan_payment_methods,
  count(transaction_id) FILTER (WHERE r.failure_reason_id IS NULL) AS orphan_failure_reasons,
  CASE WHEN count(transaction_id) FILTER (WHERE c.customer_id IS NULL OR m.merchant_id IS NULL
    OR p.payment_method_id IS NULL OR r.failure_reason_id IS NULL) = 0
  THEN 'PASSED (0 Orphan Records)' ELSE 'FAILED (Orphans Detected)' END AS foreign_key_integrity_status
  FROM fact_transactions f LEFT JOIN dim_customers c ON f.customer_id = c.customer_id
  LEFT JOIN dim_merchants m ON f.merchant_id = m.merchant_id
  LEFT JOIN dim_payment_methods p ON f.payment_method_id = p.payment_method_id
  LEFT JOIN dim_failure_reasons r ON f.failure_reason_id = r.failure_reason_id""",
    "default_fill": """SELECT transaction_id,
  CASE WHEN transaction_id % 3 <> 0 THEN is_international ELSE 0 END AS is_international,
  CASE WHEN transaction_id % 5 <> 0 THEN is_fraud ELSE 0 END AS is_fraud,
  CASE WHEN transaction_id % 7 <> 0 THEN failed_txn_count_24h ELSE 0 END AS failed_txn_count_24h
  FROM fact_transactions""",
    "layout_for_lookup": f"""SELECT strftime(transaction_timestamp, '%Y-%m') AS txn_month, transaction_status,
  count(*) AS transaction_count, {money('sum(cents)')} AS total_volume_inr FROM fact_transactions GROUP BY 1, 2""",
}

SQL = {name: star(body) for name, body in BODIES.items()}
