"""Oracles of the feed-to-star steps and of the profile."""

from decimal import Decimal

from oracles.star import money, pct, raw, star
from tillscope.schemas import RAW_FEED

SEGMENTS = [("'Retail'", "0.50"), ("'Premium'", "0.20"), ("'Corporate'", "0.10"), ("'SMB'", "0.20")]
CITIES = [
    ("'Mumbai'", "0.25"),
    ("'Bengaluru'", "0.25"),
    ("'Delhi NCR'", "0.20"),
    ("'Hyderabad'", "0.12"),
    ("'Chennai'", "0.08"),
    ("'Tier-2 Cities'", "0.10"),
]
SIXTH, FIFTH = "0.166666666667", "0.2"
CATEGORIES = [
    (f"'{c}'", SIXTH)
    for c in (
        "E-commerce",
        "Travel & Hospitality",
        "Utilities",
        "Gaming",
        "Food & Dining",
        "Financial Services",
    )
]
MERCHANT_CITIES = [(c, FIFTH) for c, _ in CITIES[:5]]
GATEWAYS = [
    ("'Razorpay'", "0.35"),
    ("'PayU'", "0.25"),
    ("'Cashfree'", "0.15"),
    ("'HDFC Direct'", "0.15"),
    ("'Paytm Gateway'", "0.10"),
]
REASONS = [("1", "0.35"), ("2", "0.25"), ("3", "0.18"), ("4", "0.12"), ("5", "0.10")]


def drawn(salt: str, key: str, slot: int) -> str:
    return f"CAST('0x' || substr(md5('{salt}:' || {key}), {1 + 8 * slot}, 8) AS BIGINT)"


def pick(salt: str, key: str, slot: int, options: list) -> str:
    total, out = Decimal(0), "CASE"
    for value, weight in options[:-1]:
        total += Decimal(weight)
        out += f" WHEN {drawn(salt, key, slot)} < {int(total * 2**32)} THEN {value}"
    return f"{out} ELSE {options[-1][0]} END"


CITY = pick("customer", "customer_id", 1, CITIES)
LUCK = drawn("transaction", "transaction_id", 1)

CUSTOMERS = f""", drawn_customers AS (
  SELECT customer_id, min_by(account_age_days, transaction_id) AS account_age_days,
         min_by(credit_score_band, transaction_id) AS credit_score_band,
         min_by(kyc_level, transaction_id) AS kyc_level,
         min_by(avg_monthly_spend, transaction_id) AS avg_monthly_spend,
         {pick('customer', 'customer_id', 0, SEGMENTS)} AS customer_segment, {CITY} AS city
  FROM raw_feed GROUP BY customer_id)"""
LABELLED = f"""{CUSTOMERS}, peaked AS (
  SELECT r.*, coalesce(is_fraud <> 1 AND month(t) = 7 AND hour(t) BETWEEN 18 AND 22 AND payment_channel = 'upi'
           AND city = 'Tier-2 Cities', false) AS is_peak
  FROM (SELECT *, CAST(substr(transaction_time, 1, 19) AS TIMESTAMP) AS t FROM raw_feed) r
  LEFT JOIN drawn_customers USING (customer_id)),
tried AS (
  SELECT *, CASE WHEN is_peak THEN {LUCK} < {int(Decimal('0.35') * 2**32)}
                 ELSE {LUCK} >= {int(Decimal('0.88') * 2**32)} END AS lost FROM peaked),
labelled AS (
  SELECT *, CASE WHEN is_fraud = 1 THEN 'FRAUD_BLOCKED' WHEN lost THEN 'FAILED' ELSE 'SUCCESS' END
           AS transaction_status,
         CASE WHEN is_fraud = 1 THEN 6 WHEN NOT lost THEN 0 WHEN is_peak THEN 4
              ELSE {pick('transaction', 'transaction_id', 2, REASONS)} END AS failure_reason_id,
         {pick('transaction', 'transaction_id', 0, GATEWAYS)} AS gateway FROM tried)"""

RAW_TYPES = [(f.name, f.dataType.simpleString()) for f in RAW_FEED]
NUMBERS = {n: t for n, t in RAW_TYPES if t != "string"}
REFERENCE = "CAST(1234567890123456000 AS BIGINT) + transaction_id"


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def round4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 5e-1) / 1e4"


def numeric(name: str, kind: str, table: str) -> str:
    """The line of one column; whole numbers are averaged and halved as such, as a double has too few digits for long ids."""
    if kind == "double":
        low, high, mean, middle = f"min({name})", f"max({name})", f"avg({name})", f"median({name})"
        exact = [f"printf('%.4f', {round4(x)})" for x in (low, high, middle)]
    else:
        low, high, mean = f"min({name})", f"max({name})", f"CAST(sum(CAST({name} AS HUGEINT)) AS DOUBLE) / count({name})"
        twice = f"(CAST(quantile_disc({name}, 0.5) AS HUGEINT) - quantile_disc(-{name}, 0.5))"
        middle = f"CAST({twice} AS DOUBLE) / 2"
        exact = [f"{low} || '.0000'", f"{high} || '.0000'", f"({twice} // 2) || CASE WHEN {twice} % 2 = 0 THEN '.0000' ELSE '.5000' END"]
    return (
        f"SELECT '{name}' AS column_name, {round4(low)} AS min_value, {round4(high)} AS max_value, {round4(mean)} AS mean_value,"
        f" {round4(middle)} AS median_value, {exact[0]} AS min_exact, {exact[1]} AS max_exact, {exact[2]} AS median_exact FROM {table}"
    )


N_RAW = "(SELECT count(*) FROM raw_feed)"
BAND = "CASE WHEN transaction_id % 1000 = 1 THEN 'band A' ELSE CAST(credit_score_band AS VARCHAR) END"


def drift() -> str:
    """Types that Spark infers from the exported feed: the narrowest whole number, a timestamp where all texts are times."""
    parts = []
    for i, (name, kind) in enumerate(RAW_TYPES):
        shape = f"CASE WHEN max(abs({name})) < 2147483648 THEN 'int' ELSE 'bigint' END" if kind == "bigint" else f"'{kind}'"
        verdict = f"CASE WHEN {shape} = '{kind}' THEN 'SAME' ELSE 'NARROWED' END"
        lost, example = "count(*) FILTER (WHERE false)", "CAST(NULL AS VARCHAR)"
        if name == "transaction_time":
            shape, verdict = "'timestamp'", "'NARROWED'"
        if name == "credit_score_band":
            shape, verdict = "'string'", "'TO TEXT'"
            lost, example = "count(*) FILTER (WHERE transaction_id % 1000 = 1)", "'band A'"
        parts.append(
            f"SELECT {i + 1} AS position, '{name}' AS column_name, '{kind}' AS declared_type, {shape} AS inferred_type,"
            f" {verdict} AS verdict, {lost} AS lost_values, {example} AS example FROM raw_feed"
        )
    return union(parts)

BODIES = {
    "scan_csv_inferred": "SELECT "
    + ", ".join(
        f"{BAND} AS {n}"
        if n == "credit_score_band"
        else f"substr({n}, 1, 26) AS {n}"  # times are read to the microsecond
        if n == "transaction_time"
        else f"CAST({n} AS INTEGER) AS {n}"
        if t == "bigint"
        else n
        for n, t in RAW_TYPES
    )
    + " FROM raw_feed",
    "schema_drift": drift(),
    "dim_customers_build": f"""{CUSTOMERS}
SELECT customer_id, 'Customer_' || customer_id AS customer_name, customer_segment, city, state,
  CAST(account_age_days AS INTEGER) AS account_age_days, CAST(credit_score_band AS INTEGER) AS credit_score_band,
  CAST(kyc_level AS INTEGER) AS kyc_level, avg_monthly_spend
  FROM drawn_customers JOIN city_state USING (city)""",
    "surrogate_labels": """SELECT customer_id, concat('Customer_', customer_id) AS customer_name,
  count(*) AS feed_rows FROM raw_feed GROUP BY customer_id""",
    "hash_bucket_assign": f"""SELECT transaction_id, {pick('transaction', 'transaction_id', 0, GATEWAYS)} AS gateway
  FROM raw_feed""",
    "dim_merchants_build": f""", m AS (
  SELECT merchant_id, min_by(merchant_risk_score, transaction_id) AS merchant_risk_score,
         {pick('merchant', 'merchant_id', 0, CATEGORIES)} AS merchant_category,
         {pick('merchant', 'merchant_id', 1, MERCHANT_CITIES)} AS city FROM raw_feed GROUP BY merchant_id)
SELECT merchant_id, 'Merchant_' || merchant_id AS merchant_name, merchant_category, city, state, merchant_risk_score
  FROM m JOIN city_state USING (city)""",
    "round_columns": f"""SELECT transaction_id, {money('cents')} AS amount, avg_monthly_spend, merchant_risk_score
  FROM raw_feed""",
    "channel_to_id": """, odd AS (SELECT transaction_id,
  CASE WHEN transaction_id % 11 = 0 THEN 'cheque' ELSE payment_channel END AS payment_channel FROM raw_feed)
SELECT transaction_id, payment_channel, payment_method_id
  FROM odd LEFT JOIN dim_payment_methods ON payment_channel = payment_method_code""",
    "timestamp_to_seconds": """SELECT transaction_id, substr(transaction_time, 1, 19) AS transaction_timestamp
  FROM raw_feed""",
    "capitalize_device": """SELECT transaction_id, upper(device_type[1]) || lower(device_type[2:]) AS device_type
  FROM raw_feed""",
    "scale_risk_score": """SELECT transaction_id,
  CASE WHEN NOT risk_missing THEN CAST(risk_tenths AS DOUBLE) / 10 END AS risk_score FROM raw_feed""",
    "status_rule_cascade": f"""{LABELLED}
SELECT transaction_id, customer_id, merchant_id, is_peak, transaction_status, failure_reason_id FROM labelled""",
    "fact_project": f"""{LABELLED}
SELECT transaction_id, customer_id, merchant_id, payment_method_id, failure_reason_id,
  substr(transaction_time, 1, 19) AS transaction_timestamp, {money('cents')} AS amount,
  upper(device_type[1]) || device_type[2:] AS device_type, gateway,
  CASE WHEN NOT risk_missing THEN CAST(risk_tenths AS DOUBLE) / 10 END AS risk_score, transaction_status,
  CAST(is_international AS INTEGER) AS is_international, CAST(is_fraud AS INTEGER) AS is_fraud,
  CAST(failed_txn_count_24h AS INTEGER) AS failed_txn_count_24h
  FROM labelled LEFT JOIN dim_payment_methods ON payment_channel = payment_method_code""",
    "profile_shape": union(
        f"SELECT {i + 1} AS position, '{n}' AS column_name, '{t}' AS data_type, count(*) AS total_rows,"
        f" {len(RAW_TYPES)} AS total_columns FROM raw_feed"
        for i, (n, t) in enumerate(RAW_TYPES)
    ),
    "profile_nulls": ", c AS ("
    + union(
        f"SELECT '{n}' AS column_name, count(*) - count({n}) AS null_count, {pct(f'count(*) - count({n})', 'count(*)')}"
        f" AS null_pct FROM raw_feed"
        for n, _ in RAW_TYPES
    )
    + """)
SELECT *, CASE WHEN (SELECT max(null_count) FROM c) > 0 THEN 'YES' ELSE 'NO' END AS any_nulls FROM c""",
    "profile_duplicates": f""", f AS (SELECT * FROM raw_feed UNION ALL SELECT * FROM raw_feed WHERE transaction_id % 50 = 0),
d AS (SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f) u) AS duplicate_rows FROM f)
SELECT *, {pct('duplicate_rows', 'total_rows')} AS duplicate_pct FROM d""",
    "profile_column_roles": union(
        f"SELECT '{n}' AS column_name, '{t}' AS data_type,"
        f" '{'date' if n == 'transaction_time' else 'text' if t == 'string' else 'numeric'}' AS column_role,"
        f" count({n}) AS present_values FROM raw_feed"
        for n, t in RAW_TYPES
    ),
    "profile_timestamps": """, p AS (SELECT CAST(substr(transaction_time, 1, 19) AS TIMESTAMP) AS t FROM raw_feed),
s AS (SELECT count(*) AS n, min(t) AS lo, max(t) AS hi FROM p)
SELECT 'transaction_time' AS column_name, n AS total_rows, n AS valid_count, CAST(0 AS BIGINT) AS failed_count,
  strftime(lo, '%Y-%m-%d %H:%M:%S') || '.328105' AS earliest, strftime(hi, '%Y-%m-%d %H:%M:%S') || '.328105' AS latest,
  CAST(datediff('microsecond', lo, hi) AS DOUBLE) / CAST(86400000000 AS DOUBLE) AS range_days,
  CAST(datediff('microsecond', lo, hi) AS DOUBLE) / CAST(86400000000 AS DOUBLE) / CAST('30.4375' AS DOUBLE)
    AS range_months FROM s""",
    "profile_categories": ", v AS ("
    + union(
        f"SELECT '{n}' AS column_name, {n} AS value, count(*) AS value_count FROM raw_feed GROUP BY {n}"
        for n in ("payment_channel", "device_type")
    )
    + f"""),
r AS (SELECT *, count(*) OVER (PARTITION BY column_name) AS cardinality,
  row_number() OVER (PARTITION BY column_name ORDER BY value_count DESC, value NULLS FIRST) AS rnk FROM v)
SELECT column_name, cardinality, CAST(rnk AS INTEGER) AS value_rank, value, value_count,
  {pct('value_count', N_RAW)} AS value_pct FROM r WHERE rnk <= 5""",
    "profile_numeric": f""", long_ids AS (SELECT *, {REFERENCE} AS network_reference FROM raw_feed)
"""
    + union(numeric(n, t, "long_ids") for n, t in [*NUMBERS.items(), ("network_reference", "bigint")]),
}

SQL = {name: raw(body) for name, body in BODIES.items()}


def lines(section: str, query: str, metrics: dict[str, str], subject: str = "column_name") -> list[str]:
    """One SELECT per metric over the oracle of a profile part."""
    return [
        f"SELECT '{section}' AS section, {subject} AS column_name, '{m}' AS metric, {value} AS value FROM ({query}) q"
        for m, value in metrics.items()
    ]


def text(*names: str) -> dict[str, str]:
    return {n: f"CAST({n} AS VARCHAR)" for n in names}


def fixed(places: int, *names: str) -> dict[str, str]:
    return {n: f"printf('%.{places}f', {n})" for n in names}


ALL_DUPLICATES = raw(
    f""", d AS (SELECT (SELECT count(*) FROM raw_feed) AS total_rows,
  (SELECT count(*) FROM raw_feed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw_feed) u) AS duplicate_rows)
SELECT *, {pct('duplicate_rows', 'total_rows')} AS duplicate_pct FROM d"""
)

SQL["profile_report"] = union(
    [
        *lines("shape", SQL["profile_shape"], {"data_type": "data_type", **text("total_rows")}),
        *lines("nulls", SQL["profile_nulls"], {**text("null_count"), **fixed(2, "null_pct")}),
        *lines("duplicates", ALL_DUPLICATES, {**text("duplicate_rows"), **fixed(2, "duplicate_pct")}, "'*'"),
        *lines("roles", SQL["profile_column_roles"], {"column_role": "column_role"}),
        *lines(
            "timestamps",
            SQL["profile_timestamps"],
            {**text("valid_count", "failed_count"), "earliest": "earliest", "latest": "latest"},
        ),
        *lines(
            "categories",
            SQL["profile_categories"],
            text("value_count"),
            "column_name || ' #' || value_rank || ' ' || coalesce(value, '<NULL>')",
        ),
        *lines(
            "categories",
            f"SELECT DISTINCT column_name, cardinality FROM ({SQL['profile_categories']}) c",
            text("cardinality"),
        ),
        *lines(
            "numbers",
            raw(union(numeric(n, t, "raw_feed") for n, t in NUMBERS.items())),
            {"min_value": "min_exact", "max_value": "max_exact", **fixed(4, "mean_value"), "median_value": "median_exact"},
        ),
    ]
)

SQL.update(
    {
        "lookup_map": star(
            """, c AS (SELECT customer_id, CASE WHEN customer_id % 7 = 0 THEN 'Elsewhere' ELSE city END AS city
  FROM dim_customers)
SELECT customer_id, city, state FROM c LEFT JOIN city_state USING (city)"""
        ),
        "status_distribution": star(
            f"""SELECT transaction_status, count(*) AS transaction_count,
  {pct('count(*)', '(SELECT count(*) FROM fact_transactions)')} AS status_pct
  FROM fact_transactions GROUP BY transaction_status"""
        ),
        "reason_distribution": star(
            f"""SELECT failure_reason_id, coalesce(failure_reason_code, 'UNKNOWN') AS failure_reason_code,
  count(*) AS transaction_count, {pct('count(*)', '(SELECT count(*) FROM fact_transactions)')} AS reason_pct
  FROM fact_transactions LEFT JOIN dim_failure_reasons USING (failure_reason_id) GROUP BY 1, 2"""
        ),
        "scenario_verification": star(
            f""", scoped AS (
  SELECT f.*, month(transaction_timestamp) = 7 AND hour(transaction_timestamp) BETWEEN 18 AND 22
              AND payment_method_code = 'upi' AND c.city = 'Tier-2 Cities' AS peak
  FROM fact_transactions f LEFT JOIN dim_customers c USING (customer_id)
  LEFT JOIN dim_payment_methods m USING (payment_method_id)),
lines AS (
  SELECT 'peak' AS scope, * FROM scoped WHERE is_fraud = 0 AND peak
  UNION ALL SELECT 'baseline', * FROM scoped WHERE is_fraud = 0 AND NOT peak
  UNION ALL SELECT 'non_fraud', * FROM scoped WHERE is_fraud = 0)
SELECT scope, count(*) AS total_txns, count(*) FILTER (WHERE transaction_status = 'FAILED') AS failed_txns,
  {pct("count(*) FILTER (WHERE transaction_status = 'FAILED')", 'count(*)')} AS failure_rate_pct,
  (SELECT count(*) FROM fact_transactions WHERE (transaction_status = 'FRAUD_BLOCKED') <> (is_fraud = 1))
    AS flag_disagreements FROM lines GROUP BY scope"""
        ),
    }
)
