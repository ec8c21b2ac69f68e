"""Oracles of the named reports."""

from oracles.star import avg_money, avg_tenths, half_up, money, pct, ratio, star

S = "count(*) FILTER (WHERE transaction_status = '{}')"
SC = "sum(cents) FILTER (WHERE transaction_status = '{}')"
OK, BAD, FRAUD = (S.format(x) for x in ("SUCCESS", "FAILED", "FRAUD_BLOCKED"))
OKC, BADC, FRAUDC = (SC.format(x) for x in ("SUCCESS", "FAILED", "FRAUD_BLOCKED"))
N = "count(*)"
WINDOW = """CASE WHEN hour(transaction_timestamp) BETWEEN 0 AND 5 THEN 'Off-Hours (12 AM - 5 AM)'
  ELSE 'Standard Operating Hours (6 AM - 11 PM)' END"""

PEAK = """FROM fact_transactions f JOIN dim_payment_methods m USING (payment_method_id)
  JOIN dim_customers c USING (customer_id) JOIN dim_failure_reasons r USING (failure_reason_id)
  WHERE month(transaction_timestamp) = 7 AND payment_method_code = 'upi' AND c.city = 'Tier-2 Cities'
  GROUP BY hour(transaction_timestamp)"""

PARETO = """, losses AS (
  SELECT merchant_id, merchant_name, merchant_category, city, count(*) AS n, sum(cents) AS loss
  FROM fact_transactions JOIN dim_merchants USING (merchant_id) WHERE transaction_status = 'FAILED'
  GROUP BY ALL),
ranked AS (
  SELECT *, sum(loss) OVER (ORDER BY loss DESC, merchant_id ROWS UNBOUNDED PRECEDING) AS running,
         sum(loss) OVER () AS total, row_number() OVER (ORDER BY loss DESC, merchant_id) AS rnk FROM losses),
cut AS (SELECT *, """ + pct("running", "total") + """ AS cum FROM ranked)"""

CHURN = """, totals AS (
  SELECT customer_id, customer_name, customer_segment, city, count(*) AS n, sum(cents) AS c, """ + BAD + """ AS fn
  FROM fact_transactions JOIN dim_customers USING (customer_id) GROUP BY ALL)"""

LEAK = """, leak AS (
  SELECT failure_reason_code, failure_category, failure_reason_description, count(*) AS n, sum(cents) AS c
  FROM fact_transactions JOIN dim_failure_reasons USING (failure_reason_id) WHERE failure_reason_id > 0 GROUP BY ALL)"""

BODIES = {
    "macro_kpis": f"""SELECT {N} AS total_transactions, {money('sum(cents)')} AS total_gmv_inr,
  {OK} AS successful_txn_count, {money(OKC)} AS successful_volume_inr, {BAD} AS failed_txn_count,
  {money(BADC)} AS revenue_at_risk_inr, {FRAUD} AS fraud_blocked_count, {money(FRAUDC)} AS fraud_blocked_volume_inr,
  {pct(OK, N)} AS overall_success_rate_pct, {pct(BAD, N)} AS overall_failure_rate_pct, {pct(FRAUD, N)} AS fraud_rate_pct
  FROM fact_transactions""",
    "macro_kpis_case": f"""SELECT {N} AS total_transactions, {money('sum(cents)')} AS total_gmv_inr,
  {money("sum(CASE WHEN transaction_status = 'SUCCESS' THEN cents ELSE 0 END)")} AS successful_volume_inr,
  {money("sum(CASE WHEN transaction_status = 'FAILED' THEN cents ELSE 0 END)")} AS revenue_at_risk_inr,
  {money("sum(CASE WHEN transaction_status = 'FRAUD_BLOCKED' THEN cents ELSE 0 END)")} AS fraud_blocked_inr,
  {pct(OK, N)} AS success_rate_pct, {pct(BAD, N)} AS failure_rate_pct, {pct(FRAUD, N)} AS fraud_rate_pct
  FROM fact_transactions""",
    "channel_performance": f"""SELECT payment_method_name, category_type, {N} AS total_attempts,
  {money('sum(cents)')} AS total_volume_inr, {avg_money('sum(cents)', 'count(cents)')} AS avg_ticket_size, {OK} AS success_count,
  {BAD} AS failed_count, {pct(OK, N)} AS success_rate_pct, {pct(BAD, N)} AS failure_rate_pct
  FROM fact_transactions JOIN dim_payment_methods USING (payment_method_id)
  GROUP BY payment_method_name, category_type""",
    "segment_matrix": f"""SELECT customer_segment, count(DISTINCT customer_id) AS total_customers,
  {N} AS total_transactions, {money('sum(cents)')} AS total_spend_inr, {avg_money('sum(cents)', 'count(cents)')} AS avg_txn_size,
  {pct(BAD, N)} AS segment_failure_rate_pct
  FROM fact_transactions JOIN dim_customers USING (customer_id) GROUP BY customer_segment""",
    "offhours_fraud": f"""SELECT {WINDOW} AS time_window, {N} AS total_transactions,
  {money('sum(cents)')} AS total_volume_inr, count(*) FILTER (WHERE is_fraud = 1) AS fraud_count,
  {money('sum(cents) FILTER (WHERE is_fraud = 1)')} AS fraud_volume_inr,
  {pct('count(*) FILTER (WHERE is_fraud = 1)', N)} AS fraud_rate_pct,
  {avg_tenths('sum(risk_tenths)', 'count(risk_tenths)')} AS mean_risk_score,
  count(*) FILTER (WHERE is_fraud = 1 AND cents > 500000) AS high_ticket_fraud_count
  FROM fact_transactions GROUP BY 1""",
    "offhours_surge_ratio": f""", big AS (SELECT *, hour(transaction_timestamp) BETWEEN 0 AND 5 AS night
  FROM fact_transactions WHERE cents > 500000),
counts AS (SELECT count(*) FILTER (WHERE night) AS offhours_txns, count(*) FILTER (WHERE night AND is_fraud = 1)
  AS offhours_fraud, count(*) FILTER (WHERE NOT night) AS daytime_txns,
  count(*) FILTER (WHERE NOT night AND is_fraud = 1) AS daytime_fraud FROM big)
SELECT *, ({ratio('offhours_fraud', 'offhours_txns')}) / NULLIF({ratio('daytime_fraud', 'daytime_txns')}, 0)
  AS surge_ratio FROM counts""",
    "corridor_risk": f"""SELECT CASE WHEN is_international = 1 THEN 'International' ELSE 'Domestic' END AS corridor_type,
  {N} AS total_transactions, {money('sum(cents)')} AS total_gmv_inr,
  count(*) FILTER (WHERE is_fraud = 1) AS fraud_txns,
  {money('sum(cents) FILTER (WHERE is_fraud = 1)')} AS fraud_gmv_inr,
  {pct('count(*) FILTER (WHERE is_fraud = 1)', N)} AS fraud_rate_pct,
  {avg_tenths('sum(risk_tenths)', 'count(risk_tenths)')} AS avg_post_auth_risk_score
  FROM fact_transactions GROUP BY is_international""",
    "category_fraud": f"""SELECT merchant_category, {N} AS total_attempts,
  count(*) FILTER (WHERE is_fraud = 1) AS fraud_incidents,
  {money('sum(cents) FILTER (WHERE is_fraud = 1)')} AS fraud_loss_inr,
  {pct('count(*) FILTER (WHERE is_fraud = 1)', N)} AS category_fraud_rate_pct
  FROM fact_transactions JOIN dim_merchants USING (merchant_id) GROUP BY merchant_category""",
    "merchant_pareto": f"""{PARETO}
SELECT rnk AS merchant_rank, merchant_id, merchant_name, merchant_category, city, n AS failed_txn_count,
  {money('loss')} AS merchant_lost_revenue_inr, {money('running')} AS running_lost_revenue_inr,
  cum AS cumulative_loss_pct FROM cut WHERE cum <= 80""",
    "recoverable_gmv": f"""SELECT failure_reason_code, failure_category, {N} AS recoverable_txn_count,
  {money('sum(cents)')} AS recoverable_gmv_inr,
  {pct('sum(cents)', "(SELECT sum(cents) FROM fact_transactions WHERE transaction_status = 'FAILED')")}
  AS pct_of_failed_volume
  FROM fact_transactions JOIN dim_failure_reasons USING (failure_reason_id)
  WHERE failure_category = 'Infrastructure' GROUP BY failure_reason_code, failure_category""",
    "failure_decomposition": f"""{LEAK}
SELECT failure_reason_code, failure_category, failure_reason_description, n AS failed_txn_count,
  {money('c')} AS total_lost_amount_inr, {pct('c', '(SELECT sum(c) FROM leak)')} AS pct_share_lost_volume,
  CAST(dense_rank() OVER (ORDER BY c DESC) AS INTEGER) AS loss_rank FROM leak""",
    "leakage_count_share": f"""{LEAK}
SELECT failure_reason_code, failure_category, failure_reason_description, n AS failed_txn_count,
  {money('c')} AS total_lost_amount_inr,
  {pct('n', '(SELECT count(*) FROM fact_transactions WHERE failure_reason_id > 0)')} AS pct_share_failed_count
  FROM leak""",
    "peak_hour_anomaly": f"""SELECT CAST(hour(transaction_timestamp) AS INTEGER) AS hour_of_day, {N} AS total_attempts,
  {BAD} AS failed_attempts, {pct(BAD, N)} AS failure_rate_pct,
  {money("coalesce(sum(cents) FILTER (WHERE failure_reason_code = 'GATEWAY_TIMEOUT'), 0)")}
  AS gateway_timeout_lost_revenue_inr {PEAK}""",
    "peak_hour_anomaly_zero": f"""SELECT CAST(hour(transaction_timestamp) AS INTEGER) AS hour_of_day,
  {N} AS total_attempts, {BAD} AS failed_attempts, {pct(BAD, N)} AS failure_rate_pct,
  {money("sum(CASE WHEN failure_reason_code = 'GATEWAY_TIMEOUT' THEN cents ELSE 0 END)")}
  AS gateway_timeout_lost_inr {PEAK}""",
    "churn_risk_tiers": f"""{CHURN}, rated AS (SELECT *, {pct('fn', 'n')} AS rate FROM totals)
SELECT customer_id, customer_name, customer_segment, city, {money('c')} AS total_attempted_spend_inr,
  n AS total_attempts, fn AS failed_txns, rate AS failure_rate_pct,
  CASE WHEN c >= 5000000 AND rate >= 30 THEN 'Tier 1 - Critical Churn Risk'
       WHEN c >= 3500000 AND rate >= 25 THEN 'Tier 2 - Severe Churn Risk'
       ELSE 'Tier 3 - Moderate Churn Risk' END AS risk_tier
  FROM rated WHERE c > 2500000 AND rate >= 20""",
    "at_risk_customers_having": f"""{CHURN}
SELECT customer_id, customer_name, customer_segment, city, {money('c')} AS total_attempted_spend_inr,
  n AS total_attempts, fn AS failed_attempts, {pct('fn', 'n')} AS failure_rate_pct
  FROM totals WHERE c >= 2500000 AND fn * 100 >= n * 20 ORDER BY c DESC, customer_id LIMIT 15""",
    "gateway_sla": f"""SELECT gateway, payment_method_name, {N} AS total_transactions,
  {money('sum(cents)')} AS total_processing_volume_inr, {pct(OK, N)} AS success_rate_pct,
  count(*) FILTER (WHERE failure_reason_code = 'GATEWAY_TIMEOUT') AS gateway_timeout_count,
  count(*) FILTER (WHERE failure_reason_code = 'TECHNICAL_ERROR') AS technical_error_count,
  {money(f'coalesce({BADC}, 0)')} AS total_financial_volume_lost_inr
  FROM fact_transactions JOIN dim_payment_methods USING (payment_method_id)
  JOIN dim_failure_reasons USING (failure_reason_id) GROUP BY gateway, payment_method_name""",
    "status_summary_shares": f"""SELECT transaction_status, {N} AS transaction_count,
  {pct(N, '(SELECT count(*) FROM fact_transactions)')} AS count_pct, {money('sum(cents)')} AS total_volume_inr,
  {pct('sum(cents)', '(SELECT sum(cents) FROM fact_transactions)')} AS volume_pct,
  {avg_money('sum(cents)', 'count(cents)')} AS avg_ticket_size,
  {avg_tenths('sum(risk_tenths)', 'count(risk_tenths)')} AS avg_risk_score
  FROM fact_transactions GROUP BY transaction_status""",
    "status_volume": f"""SELECT transaction_status, {N} AS transaction_count, {money('sum(cents)')} AS total_volume_inr,
  {avg_money('sum(cents)', 'count(cents)')} AS avg_ticket_size FROM fact_transactions GROUP BY transaction_status""",
    "top_failure_reasons": f""", lost AS (
  SELECT failure_reason_id, failure_reason_code, failure_category, count(*) AS n, sum(cents) AS c, count(cents) AS cn
  FROM fact_transactions JOIN dim_failure_reasons USING (failure_reason_id)
  WHERE transaction_status IN ('FAILED', 'FRAUD_BLOCKED') OR failure_reason_id > 0 GROUP BY ALL)
SELECT failure_reason_id, failure_reason_code, failure_category, n AS failed_txns_count,
  {money('c')} AS lost_volume_inr, {pct('c', '(SELECT sum(c) FROM lost)')} AS pct_of_failed_volume,
  {avg_money('c', 'cn')} AS avg_lost_ticket_size FROM lost ORDER BY c DESC, failure_reason_id LIMIT 5""",
    "top_merchants_by_loss": f"""SELECT merchant_id, merchant_name, merchant_category, city, {N} AS failed_txn_count,
  {money('sum(cents)')} AS total_lost_revenue_inr FROM fact_transactions JOIN dim_merchants USING (merchant_id)
  WHERE transaction_status = 'FAILED' GROUP BY ALL ORDER BY sum(cents) DESC, merchant_id LIMIT 10""",
    "city_gateway_failures": f"""SELECT gateway, {N} AS total_attempts, {BAD} AS failed_attempts,
  {pct(BAD, N)} AS failure_rate_pct,
  count(CASE WHEN failure_reason_code = 'GATEWAY_TIMEOUT' THEN 1 END) AS timeout_count,
  {money("sum(CASE WHEN transaction_status = 'FAILED' THEN cents ELSE 0 END)")} AS lost_volume_inr
  FROM fact_transactions JOIN dim_customers c USING (customer_id) JOIN dim_failure_reasons USING (failure_reason_id)
  WHERE c.city = 'Tier-2 Cities' GROUP BY gateway""",
    "offhours_high_ticket_list": f"""SELECT transaction_id,
  strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S') AS transaction_timestamp,
  {money('cents')} AS transaction_amount_inr, gateway, payment_method_name,
  CAST(risk_tenths AS DOUBLE) / 10 AS risk_score, device_type
  FROM fact_transactions JOIN dim_payment_methods USING (payment_method_id)
  WHERE is_fraud = 1 AND cents > 500000 AND hour(transaction_timestamp) BETWEEN 0 AND 5
  ORDER BY cents DESC, transaction_id, transaction_timestamp, gateway, payment_method_name,
    risk_score NULLS FIRST, device_type LIMIT 20""",
}

SQL = {name: star(body) for name, body in BODIES.items()}
