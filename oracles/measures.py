"""Oracles of the measure layer, each written out by hand for its filter context."""

from oracles.star import money, safe, star

JOINED = """, j AS (
  SELECT f.*, payment_method_code, failure_reason_code, failure_category, c.city AS customer_city, customer_segment,
         merchant_category, hour(transaction_timestamp) AS h, month(transaction_timestamp) AS mo
  FROM fact_transactions f JOIN dim_payment_methods USING (payment_method_id)
  JOIN dim_failure_reasons USING (failure_reason_id) JOIN dim_customers c USING (customer_id)
  JOIN dim_merchants USING (merchant_id))"""


def n(cond: str = "true") -> str:
    return f"count(*) FILTER (WHERE {cond})"


def vol(cond: str = "true") -> str:
    return f"sum(cents) FILTER (WHERE {cond})"


OK, BAD, FRAUD = (f"transaction_status = '{s}'" for s in ("SUCCESS", "FAILED", "FRAUD_BLOCKED"))
PEAK = "customer_city = 'Tier-2 Cities' AND payment_method_code = 'upi' AND is_fraud = 0"
INFRA = vol("failure_category = 'Infrastructure'")
PEAK_RATE = safe(n(f"{BAD} AND {PEAK}"), n(PEAK))
BASE_RATE = safe(n(f"{BAD} AND is_fraud = 0"), n("is_fraud = 0"))
NIGHT = "h BETWEEN 0 AND 5"


def code(name: str) -> str:
    return f"failure_reason_code = '{name}'"


PER_CUSTOMER = """, pc AS (
  SELECT customer_id, customer_segment, sum(cents) AS c, count(*) AS n,
         count(*) FILTER (WHERE transaction_status = 'FAILED') AS x FROM j GROUP BY customer_id, customer_segment)"""
AT_RISK = "c >= 2500000 AND x * 100 >= n * 20"

BODIES = {
    "measures_core": f"""{JOINED}
SELECT payment_method_code, {money('sum(cents)')} AS total_gross_volume_gmv, {money(vol(OK))} AS successful_volume,
  {money(vol(BAD))} AS revenue_at_risk_failed, {money(vol(FRAUD))} AS fraud_blocked_volume,
  count(*) AS total_transactions, {n(OK)} AS successful_transactions, {n(BAD)} AS failed_transactions,
  {n(FRAUD)} AS fraud_blocked_transactions, {safe(n(OK), 'count(*)')} AS success_rate,
  {safe(n(BAD), 'count(*)')} AS failure_rate, {safe(n(FRAUD), 'count(*)')} AS fraud_rate,
  CAST(sum(cents) AS DOUBLE) / count(cents) / 100 AS average_ticket_size,
  CAST(sum(risk_tenths) AS DOUBLE) / count(risk_tenths) / 10 AS average_risk_score
  FROM j GROUP BY payment_method_code""",
    "measures_leakage": f"""{JOINED}
SELECT {money(INFRA)} AS infrastructure_lost_revenue,
  {money(vol("failure_category = 'Customer Side'"))} AS customer_side_lost_revenue,
  {money(vol("failure_category = 'Risk & Compliance'"))} AS risk_compliance_lost_revenue,
  {money(vol(code('GATEWAY_TIMEOUT')))} AS gateway_timeout_lost_volume,
  {money(vol(code('TECHNICAL_ERROR')))} AS technical_error_lost_volume,
  {money(vol(code('BANK_DECLINED')))} AS bank_declined_lost_volume,
  {money(vol(code('INSUFFICIENT_FUNDS')))} AS insufficient_funds_lost_volume,
  {safe(INFRA, f"(coalesce({vol(BAD)}, 0) + coalesce({vol(FRAUD)}, 0))")} AS infrastructure_loss_share,
  {safe(INFRA, vol(BAD))} AS infrastructure_loss_share_of_failed,
  {money(vol("failure_reason_code IN ('GATEWAY_TIMEOUT', 'TECHNICAL_ERROR')"))} AS recoverable_baseline_gmv,
  {PEAK_RATE} AS peak_fail_rate, {money(vol(PEAK))} AS peak_total_volume,
  {money(vol(f"{PEAK} AND {code('GATEWAY_TIMEOUT')}"))} AS peak_timeout_lost_volume,
  {BASE_RATE} AS baseline_failure_rate, {PEAK_RATE} - {BASE_RATE} AS peak_vs_baseline_delta FROM j""",
    "measures_customer_merchant": f"""{JOINED}{PER_CUSTOMER}, pm AS (
  SELECT merchant_id, sum(cents) AS loss FROM j WHERE transaction_status = 'FAILED' GROUP BY merchant_id),
rm AS (SELECT *, rank() OVER (ORDER BY loss DESC) AS rnk FROM pm)
SELECT (SELECT count(*) FROM dim_customers) AS total_customers,
  (SELECT count(*) FROM pc WHERE c >= 2500000) AS high_spend_customers,
  (SELECT count(*) FROM pc WHERE {AT_RISK}) AS at_risk_customers,
  (SELECT {money('sum(c)')} FROM pc WHERE {AT_RISK}) AS at_risk_customer_spend,
  {safe(f'(SELECT sum(c) FROM pc WHERE {AT_RISK})', '(SELECT sum(c) FROM pc)')} AS at_risk_customer_spend_share,
  (SELECT count(*) FROM dim_merchants) AS total_merchants, (SELECT count(*) FROM pm) AS merchants_with_failures,
  {safe('(SELECT sum(loss) FROM pm)', '(SELECT count(*) FROM dim_merchants)')} / 100 AS avg_lost_revenue_per_merchant,
  {safe('(SELECT sum(loss) FROM rm WHERE rnk <= 20)', '(SELECT sum(loss) FROM pm)')} AS top_20_merchant_loss_share""",
    "measures_gateway_fraud": f"""{JOINED}
SELECT gateway, {safe(n(OK), 'count(*)')} AS gateway_success_rate,
  {safe(n(code('GATEWAY_TIMEOUT')), 'count(*)')} AS gateway_timeout_rate,
  {safe(n(code('TECHNICAL_ERROR')), 'count(*)')} AS technical_error_rate,
  CASE WHEN {safe(n(OK), 'count(*)')} >= 0.865 THEN 'SLA Compliant (>= 86.5%)' ELSE 'SLA Breach (< 86.5%)' END
    AS gateway_sla_status,
  {money(vol(f'{FRAUD} AND {NIGHT}'))} AS off_hours_fraud_volume,
  {safe(n(f'{FRAUD} AND {NIGHT}'), n(NIGHT))} AS off_hours_fraud_rate,
  {safe(vol(f'{FRAUD} AND is_international = 1'), vol(FRAUD))} AS international_fraud_loss_share
  FROM j GROUP BY gateway""",
    "measure_by_dims": f"""{JOINED}, pc AS (
  SELECT customer_segment, payment_method_code, customer_id, sum(cents) AS c, count(*) AS n, {n(BAD)} AS x,
    CAST(GROUPING(customer_segment) + GROUPING(payment_method_code) AS INTEGER) AS totals_level
  FROM j WHERE mo = 7 GROUP BY GROUPING SETS (
    (customer_segment, payment_method_code, customer_id), (customer_segment, customer_id), (customer_id))),
r AS (SELECT customer_segment, payment_method_code, totals_level, count(*) FILTER (WHERE {AT_RISK}) AS at_risk_customers
  FROM pc GROUP BY ALL),
s AS (SELECT customer_segment, payment_method_code,
  CAST(GROUPING(customer_segment) + GROUPING(payment_method_code) AS INTEGER) AS totals_level,
  {money('sum(cents)')} AS total_gross_volume_gmv, count(*) AS total_transactions,
  {safe(n(BAD), 'count(*)')} AS failure_rate, {money(INFRA)} AS infrastructure_lost_revenue
  FROM j WHERE mo = 7 GROUP BY ROLLUP (customer_segment, payment_method_code))
SELECT s.*, at_risk_customers FROM s JOIN r ON s.totals_level = r.totals_level
  AND s.customer_segment IS NOT DISTINCT FROM r.customer_segment
  AND s.payment_method_code IS NOT DISTINCT FROM r.payment_method_code""",
    "measure_filter_override": f""", shown AS (
  SELECT transaction_status, gateway, count(*) AS n, sum(cents) AS c FROM fact_transactions GROUP BY 1, 2),
lifted AS (SELECT gateway, {vol(OK)} AS ok_c, {n(BAD)} AS bad_n FROM fact_transactions GROUP BY 1)
SELECT transaction_status, s.gateway, {money('c')} AS total_gross_volume_gmv, {money('ok_c')} AS successful_volume,
  n AS total_transactions, bad_n AS failed_transactions, {safe('bad_n', 'n')} AS failure_rate
  FROM shown s JOIN lifted l ON s.gateway IS NOT DISTINCT FROM l.gateway""",
    "measure_all_denominator": f"""{JOINED}, pm AS (
  SELECT merchant_category, merchant_id, sum(cents) AS loss FROM j WHERE {BAD} GROUP BY 1, 2),
rm AS (SELECT *, rank() OVER (PARTITION BY merchant_category ORDER BY loss DESC) AS rnk FROM pm)
SELECT merchant_category, {money('sum(loss)')} AS revenue_at_risk_failed,
  {safe('sum(loss) FILTER (WHERE rnk <= 20)', '(SELECT sum(loss) FROM pm)')} AS top_20_merchant_loss_share
  FROM rm GROUP BY merchant_category""",
    "measure_entity_filter": f"""{JOINED}{PER_CUSTOMER}
SELECT customer_segment,
  (SELECT count(*) FROM dim_customers d WHERE d.customer_segment = pc.customer_segment) AS total_customers,
  count(*) FILTER (WHERE c >= 2500000) AS high_spend_customers, count(*) FILTER (WHERE {AT_RISK}) AS at_risk_customers,
  {money(f'sum(c) FILTER (WHERE {AT_RISK})')} AS at_risk_customer_spend,
  {safe(f'sum(c) FILTER (WHERE {AT_RISK})', 'sum(c)')} AS at_risk_customer_spend_share
  FROM pc GROUP BY customer_segment""",
}

SQL = {name: star(body) for name, body in BODIES.items()}
