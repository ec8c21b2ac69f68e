"""Shared leading CTEs: the star view and the raw feed over the order-line tables."""

DIMS = """WITH dim_payment_methods(payment_method_id, payment_method_code, payment_method_name, category_type) AS (
  VALUES (1, 'card', 'Credit/Debit Card', 'Card'), (2, 'upi', 'UPI Instant Pay', 'Instant Pay'),
         (3, 'wallet', 'Digital Wallet', 'Prepaid'), (4, 'bank_transfer', 'Net Banking Transfer', 'Direct Bank')),
dim_failure_reasons(failure_reason_id, failure_reason_code, failure_reason_description, failure_category) AS (
  VALUES (0, 'SUCCESS', 'Transaction Successful', 'None'),
         (1, 'INSUFFICIENT_FUNDS', 'Insufficient Customer Account Balance', 'Customer Side'),
         (2, 'BANK_DECLINED', 'Declined by Issuing Bank', 'Customer Side'),
         (3, 'TECHNICAL_ERROR', 'Gateway/Switch Technical Exception', 'Infrastructure'),
         (4, 'GATEWAY_TIMEOUT', 'Acquirer Latency Timeout', 'Infrastructure'),
         (5, 'AUTHENTICATION_FAILED', 'OTP / 3DS Auth Failed', 'Risk & Compliance'),
         (6, 'RISK_BLOCKED', 'Blocked by Fraud Risk Engine', 'Risk & Compliance')),
city_state(city, state) AS (
  VALUES ('Mumbai', 'Maharashtra'), ('Bengaluru', 'Karnataka'), ('Delhi NCR', 'Delhi'),
         ('Hyderabad', 'Telangana'), ('Chennai', 'Tamil Nadu'), ('Tier-2 Cities', 'Tier-2 Regions')),
customer_city AS (
  SELECT *, CASE WHEN c_custkey % 20 < 5 THEN 'Mumbai' WHEN c_custkey % 20 < 10 THEN 'Bengaluru'
                 WHEN c_custkey % 20 < 14 THEN 'Delhi NCR' WHEN c_custkey % 20 < 16 THEN 'Hyderabad'
                 WHEN c_custkey % 20 < 18 THEN 'Chennai' ELSE 'Tier-2 Cities' END AS city
  FROM customer),
dim_customers AS (
  SELECT c_custkey AS customer_id, 'Customer_' || c_custkey AS customer_name, c_mktsegment AS customer_segment,
         city, state, CAST(30 + (c_custkey * 37) % 1970 AS INTEGER) AS account_age_days,
         CAST(1 + c_custkey % 5 AS INTEGER) AS credit_score_band, CAST(1 + c_custkey % 3 AS INTEGER) AS kyc_level,
         CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS spend_cents,
         CAST(CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS DOUBLE) / 100 AS avg_monthly_spend
  FROM customer_city JOIN city_state USING (city)),
merchant_city AS (
  SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'Bengaluru' WHEN 2 THEN 'Delhi NCR'
                 WHEN 3 THEN 'Hyderabad' ELSE 'Chennai' END AS city FROM part),
dim_merchants AS (
  SELECT p_partkey AS merchant_id, 'Merchant_' || p_partkey AS merchant_name, p_type AS merchant_category,
         city, state, CAST((p_partkey * 13) % 10000 AS DOUBLE) / 10000 AS merchant_risk_score
  FROM merchant_city JOIN city_state USING (city)),
line AS (
  SELECT *, CAST((l_orderkey * 7 + l_linenumber * 5 + l_suppkey) % 24 AS INTEGER) AS h,
         CASE WHEN (l_partkey * 7 + l_orderkey) % 20 < 10 THEN 1 WHEN (l_partkey * 7 + l_orderkey) % 20 < 15 THEN 2
              WHEN (l_partkey * 7 + l_orderkey) % 20 < 18 THEN 3 ELSE 4 END AS method,
         (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 100 AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
marked AS (
  SELECT *, method = 2 AND o_custkey % 20 >= 18 AND month(l_shipdate) = 7 AND h BETWEEN 18 AND 22 AS hot FROM line),
judged AS (
  SELECT *, CASE WHEN score >= 98 THEN 'FRAUD_BLOCKED'
                 WHEN score < CASE WHEN hot THEN 35 WHEN o_custkey % 25 = 0 THEN 32 ELSE 12 END THEN 'FAILED'
                 ELSE 'SUCCESS' END AS status FROM marked),
fact_transactions AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id, o_custkey AS customer_id, l_partkey AS merchant_id,
         method AS payment_method_id,
         CASE WHEN status = 'FRAUD_BLOCKED' THEN 6 WHEN status = 'SUCCESS' THEN 0 WHEN hot THEN 4
              ELSE CAST(1 + (l_orderkey + l_suppkey) % 5 AS INTEGER) END AS failure_reason_id,
         l_shipdate + to_hours(h) AS transaction_timestamp,
         CAST(round(l_extendedprice * 100) AS BIGINT) // 20 AS cents,
         CASE WHEN (l_orderkey + l_partkey) % 20 < 14 THEN 'Mobile' WHEN (l_orderkey + l_partkey) % 20 < 19
              THEN 'Desktop' ELSE 'Tablet' END AS device_type,
         CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'Razorpay' WHEN 1 THEN 'PayU' WHEN 2 THEN 'Cashfree'
              WHEN 3 THEN 'HDFC Direct' ELSE 'Paytm Gateway' END AS gateway,
         CASE WHEN l_orderkey % 97 <> 0 THEN (l_orderkey * 13 + l_linenumber * 101) % 1001 END AS risk_tenths,
         status AS transaction_status, CASE WHEN l_orderkey % 100 < 7 THEN 1 ELSE 0 END AS is_international,
         CASE WHEN status = 'FRAUD_BLOCKED' THEN 1 ELSE 0 END AS is_fraud,
         CAST(l_orderkey % 5 AS INTEGER) AS failed_txn_count_24h
  FROM judged)"""

RAW = (
    DIMS
    + """,
raw_feed AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id,
         strftime(l_shipdate + to_hours(h), '%Y-%m-%d %H:%M:%S') || '.328105993' AS transaction_time,
         o_custkey AS customer_id, l_partkey AS merchant_id,
         30 + (o_custkey * 37) % 1970 AS account_age_days, 1 + o_custkey % 5 AS credit_score_band,
         1 + o_custkey % 3 AS kyc_level,
         CAST(CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS DOUBLE) / 100 AS avg_monthly_spend,
         CAST((l_partkey * 13) % 10000 AS DOUBLE) / 10000 AS merchant_risk_score,
         CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 20 AS DOUBLE) / 100 AS transaction_amount,
         CAST(round(l_extendedprice * 100) AS BIGINT) // 20 AS cents,
         CASE method WHEN 1 THEN 'card' WHEN 2 THEN 'upi' WHEN 3 THEN 'wallet' ELSE 'bank_transfer' END
           AS payment_channel,
         CASE WHEN (l_orderkey + l_partkey) % 20 < 14 THEN 'mobile' WHEN (l_orderkey + l_partkey) % 20 < 19
              THEN 'desktop' ELSE 'tablet' END AS device_type,
         CAST(CASE WHEN l_orderkey % 100 < 7 THEN 1 ELSE 0 END AS BIGINT) AS is_international,
         CAST((l_orderkey * 3 + l_linenumber) % 1000 AS DOUBLE) / 1000 AS ip_risk_score,
         l_orderkey % 3 AS txn_count_1h, l_orderkey % 7 AS txn_count_24h,
         l_orderkey % 5 AS failed_txn_count_24h,
         CAST((l_orderkey * 11 + l_linenumber) % 2000 AS DOUBLE) / 10 AS geo_distance_from_last_txn,
         CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 20 - 250000 AS DOUBLE) / 100
           AS amount_deviation_from_user_mean,
         CAST(CASE WHEN status = 'FRAUD_BLOCKED' THEN 1 ELSE 0 END AS BIGINT) AS is_fraud,
         CASE WHEN l_orderkey % 97 <> 0
              THEN CAST((l_orderkey * 13 + l_linenumber * 101) % 1001 AS DOUBLE) / 1000 END AS post_auth_risk_score,
         (l_orderkey * 13 + l_linenumber * 101) % 1001 AS risk_tenths, l_orderkey % 97 = 0 AS risk_missing
  FROM judged JOIN customer ON o_custkey = c_custkey)"""
)


def money(cents: str) -> str:
    return f"CAST(CAST({cents} AS BIGINT) AS DOUBLE) / 100"


def half_up(num: str, den: str, times: int = 1) -> str:
    return f"(2 * {times} * CAST({num} AS HUGEINT) + ({den})) // NULLIF(2 * CAST({den} AS HUGEINT), 0)"


def pct(part: str, whole: str) -> str:
    return f"CAST({half_up(part, whole, 10000)} AS DOUBLE) / 100"


def avg_money(cents: str, rows: str) -> str:
    return f"CAST({half_up(cents, rows)} AS DOUBLE) / 100"


def avg_tenths(tenths: str, rows: str) -> str:
    return f"CAST({half_up(tenths, rows)} AS DOUBLE) / 10"


def ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


def safe(a: str, b: str) -> str:
    return f"coalesce({ratio(a, b)}, 0)"


def star(body: str) -> str:
    """``body`` is either a SELECT or more CTEs, led by a comma, and a SELECT."""
    return DIMS + ("" if body.lstrip().startswith(",") else "\n") + body


def raw(body: str) -> str:
    return RAW + ("" if body.lstrip().startswith(",") else "\n") + body
