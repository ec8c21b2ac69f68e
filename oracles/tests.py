"""Oracles of the hypothesis tests, digests, free SQL and the report suite."""

from oracles import reports
from oracles.star import half_up, money, pct, ratio, star

BAD = "count(*) FILTER (WHERE transaction_status = 'FAILED')"

COUNTS = f""", seg AS (
  SELECT gateway, payment_method_id, {BAD} AS x1, count(*) AS n1 FROM fact_transactions WHERE is_fraud = 0
  GROUP BY gateway, payment_method_id),
counts AS (
  SELECT gateway, payment_method_id, x1, n1, CAST((SELECT sum(x1) FROM seg) - x1 AS BIGINT) AS x2,
         CAST((SELECT sum(n1) FROM seg) - n1 AS BIGINT) AS n2 FROM seg),
rates AS (
  SELECT *, {ratio('x1', 'n1')} AS p1, {ratio('x2', 'n2')} AS p2,
         {ratio('(CAST(x1 AS DOUBLE) + CAST(x2 AS DOUBLE))', '(CAST(n1 AS DOUBLE) + CAST(n2 AS DOUBLE))')} AS p_pool
  FROM counts),
spread AS (
  SELECT *, sqrt(p_pool * (1e0 - p_pool) * (1e0 / CAST(n1 AS DOUBLE) + 1e0 / CAST(n2 AS DOUBLE))) AS se_pool FROM rates),
tested AS (SELECT *, (p1 - p2) / se_pool AS z FROM spread)"""

EFFECTS = """(p1 - p2) * 1e2 AS abs_risk_increase, p1 / NULLIF(p2, 0) AS relative_risk,
  (p1 / (1e0 - p1)) / NULLIF(p2 / (1e0 - p2), 0) AS odds_ratio, 1e0 / NULLIF(p1 - p2, 0) AS number_needed_to_harm"""
INTERVAL = """, wide AS (SELECT *, sqrt(p1 * (1e0 - p1) / CAST(n1 AS DOUBLE) + p2 * (1e0 - p2) / CAST(n2 AS DOUBLE))
  AS se_unpooled FROM tested)"""
Z = "CAST('1.959963984540054' AS DOUBLE)"
BOUNDS = f"""se_unpooled, ((p1 - p2) - ({Z} * se_unpooled)) * 1e2 AS ci_lower,
  ((p1 - p2) + ({Z} * se_unpooled)) * 1e2 AS ci_upper"""


def upper_tail(z: str) -> str:
    """Normal tail by the power series of the distribution function around zero."""
    series = (
        f"list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln(abs({z})) - (i + 1) * ln(2e0)"
        f" - lgamma(i + 1.5e0) + ln(pi()) / 2)))"
    )
    # Far out the difference from one half cancels; the continued fraction of the tail keeps all digits.
    terms = f"list_concat([abs({z})], list_transform(range(0, 120), lambda i: 120e0 - i))"
    tail = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) / list_reduce({terms}, lambda a, k: abs({z}) + k / a)"
    near = f"0.5 - sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series}"
    return f"(CASE WHEN {z} = 0 THEN 0.5 WHEN {z} > 2.5 THEN {tail} WHEN {z} < -2.5 THEN 1 - {tail} ELSE {near} END)"


def round6(p: str) -> str:
    """Six significant digits."""
    return f"CAST(format('{{:.5e}}', {p}) AS DOUBLE)"


OUTCOMES = """, outcomes AS (
  SELECT payment_method_name, payment_method_id, gateway, transaction_status,
         CASE WHEN transaction_status = 'FAILED' THEN 'FAILED' ELSE 'NON_FAILED' END AS is_failed
  FROM fact_transactions JOIN dim_payment_methods USING (payment_method_id))"""
STATUS_COLUMNS = ", ".join(
    f"count(*) FILTER (WHERE transaction_status = '{s}') AS {s}" for s in ("SUCCESS", "FAILED", "FRAUD_BLOCKED")
)


def expected(status: str) -> str:
    cell = f"CAST(row_n AS DOUBLE) * CAST((SELECT count(*) FROM outcomes WHERE transaction_status = '{status}') AS DOUBLE)"
    return f"floor({cell} / CAST((SELECT count(*) FROM outcomes) AS DOUBLE) * 1e2 + 5e-1) / 1e2 AS expected_{status.lower()}"


CELLS = f"""{OUTCOMES},
labels AS (
  SELECT 'failed by method' AS test, payment_method_name AS r, is_failed AS c FROM outcomes
  UNION ALL SELECT 'status by method', payment_method_name, transaction_status FROM outcomes
  UNION ALL SELECT 'status by method at ' || gateway, payment_method_name, transaction_status FROM outcomes),
rows_of AS (SELECT test, r, count(*) AS rn FROM labels GROUP BY test, r),
cols_of AS (SELECT test, c, count(*) AS cn FROM labels GROUP BY test, c),
size_of AS (SELECT test, count(*) AS n FROM labels GROUP BY test),
seen AS (SELECT test, r, c, count(*) AS o FROM labels GROUP BY test, r, c),
cells AS (
  SELECT test, r, c, coalesce(o, 0) AS o, CAST(rn AS DOUBLE) * CAST(cn AS DOUBLE) / CAST(n AS DOUBLE) AS e, n
  FROM rows_of JOIN cols_of USING (test) JOIN size_of USING (test) LEFT JOIN seen USING (test, r, c)),
shares AS (
  SELECT test, r, n, list_reduce(list((CAST(o AS DOUBLE) - e) * (CAST(o AS DOUBLE) - e) / e ORDER BY
    CASE c WHEN 'SUCCESS' THEN 0 WHEN 'FAILED' THEN 1 ELSE 2 END), lambda a, b: a + b) AS share
  FROM cells GROUP BY test, r, n),
chi AS (
  SELECT test, n, CAST(sum(CAST(floor(share * 1e9 + 5e-1) AS HUGEINT)) AS DOUBLE) / 1e9 AS chi2,
         CAST((count(*) - 1) * (SELECT count(*) - 1 FROM cols_of k WHERE k.test = shares.test) AS INTEGER) AS dof
  FROM shares GROUP BY test, n)"""

CHI_TAIL = f"""CASE WHEN dof % 2 = 0
    THEN exp(-chi2 / 2) * list_sum(list_transform(range(0, dof // 2), lambda j: pow(chi2 / 2, j) / gamma(j + 1e0)))
    ELSE 2 * {upper_tail('sqrt(chi2)')} + coalesce(list_sum(list_transform(range(0, dof // 2),
      lambda j: exp(-chi2 / 2) * pow(chi2 / 2, j + 5e-1) / gamma(j + 1.5e0))), 0) END"""

SUITE = [
    (1, "Executive Performance Overview", "query1_executive_overview.csv", "macro_kpis"),
    (2, "Failure Reason Decomposition & Revenue Leakage", "query2_failure_decomposition.csv", "failure_decomposition"),
    (3, "July Evening Peak-Hour UPI Anomaly (Deep-Dive)", "query3_july_upi_anomaly.csv", "peak_hour_anomaly"),
    (
        4,
        "Pareto Analysis on Merchant Loss Concentration (80/20 Rule)",
        "query4_merchant_pareto_loss.csv",
        "merchant_pareto",
    ),
    (5, "High-Value Customer Churn Risk Analysis", "query5_high_value_churn_risk.csv", "churn_risk_tiers"),
    (6, "Gateway Performance & SLA Compliance Benchmarking", "query6_gateway_sla_benchmarking.csv", "gateway_sla"),
]

BODIES = {
    "two_sample_counts": f""", scoped AS (
  SELECT f.*, month(transaction_timestamp) = 7 AND hour(transaction_timestamp) BETWEEN 18 AND 22
              AND payment_method_code = 'upi' AND c.city = 'Tier-2 Cities' AS peak
  FROM fact_transactions f LEFT JOIN dim_customers c USING (customer_id)
  LEFT JOIN dim_payment_methods m USING (payment_method_id) WHERE is_fraud = 0)
SELECT 'peak' AS segment, count(*) FILTER (WHERE peak AND transaction_status = 'FAILED') AS x1,
  count(*) FILTER (WHERE peak) AS n1, count(*) FILTER (WHERE NOT peak AND transaction_status = 'FAILED') AS x2,
  count(*) FILTER (WHERE NOT peak) AS n2 FROM scoped""",
    "two_proportion_z": f"{COUNTS}\nSELECT * FROM tested",
    "effect_sizes": f"{COUNTS}\nSELECT *, {EFFECTS} FROM tested",
    "diff_confidence_interval": f"{COUNTS}{INTERVAL}\nSELECT * EXCLUDE (se_unpooled), {BOUNDS} FROM wide",
    "z_p_values": f"""{COUNTS}, tails AS (SELECT gateway, payment_method_id, z, {upper_tail('z')} AS p,
  2 * {upper_tail('abs(z)')} AS pp FROM tested)
SELECT gateway, payment_method_id, z, {round6('p')} AS p_one_tailed, {round6('pp')} AS p_two_tailed,
  CASE WHEN p < 0.05 THEN 'REJECT H0' ELSE 'FAIL TO REJECT H0' END AS decision FROM tails""",
    "crosstab": f"{OUTCOMES}\nSELECT payment_method_name, {STATUS_COLUMNS} FROM outcomes GROUP BY payment_method_name",
    "crosstab_margins": f"""{OUTCOMES}
SELECT coalesce(payment_method_name, 'Total') AS payment_method_name, {STATUS_COLUMNS}, count(*) AS "Total"
  FROM outcomes GROUP BY ROLLUP (payment_method_name)""",
    "expected_frequencies": f"""{OUTCOMES}, m AS (
  SELECT payment_method_name, count(*) AS row_n FROM outcomes GROUP BY payment_method_name)
SELECT payment_method_name, {expected('SUCCESS')}, {expected('FAILED')}, {expected('FRAUD_BLOCKED')} FROM m""",
    "chi_square_independence": f"{CELLS}\nSELECT test, n, chi2, dof FROM chi",
    "chi_square_p_value": f"""{CELLS}, tail AS (SELECT *, {CHI_TAIL} AS p FROM chi)
SELECT test, n, chi2, dof, {round6('p')} AS p_value,
  CASE WHEN p < 0.05 THEN 'REJECT H0' ELSE 'FAIL TO REJECT H0' END AS decision FROM tail""",
    "digest_top_share": f"""{reports.LEAK}, best AS (SELECT * FROM leak ORDER BY c DESC, failure_reason_code LIMIT 1)
SELECT failure_reason_code AS top_reason, {money('c')} AS top_amount_inr,
  {money('(SELECT sum(c) FROM leak)')} AS total_loss_inr,
  CAST({half_up('c', '(SELECT sum(c) FROM leak)', 1000)} AS DOUBLE) / 10 AS top_pct FROM best""",
    "digest_top_merchants": f""", ten AS (
  SELECT merchant_id, merchant_name, merchant_category, sum(cents) AS c FROM fact_transactions
  JOIN dim_merchants USING (merchant_id) WHERE transaction_status = 'FAILED' GROUP BY ALL
  ORDER BY c DESC, merchant_id LIMIT 10),
one AS (SELECT * FROM ten ORDER BY c DESC, merchant_id LIMIT 1)
SELECT (SELECT count(*) FROM ten) AS merchants, {money('(SELECT sum(c) FROM ten)')} AS listed_loss_inr,
  merchant_name AS top_merchant, merchant_category AS top_category, {money('c')} AS top_loss_inr FROM one""",
    "digest_worst_gateway": f"""SELECT gateway AS worst_gateway,
  {money("sum(CASE WHEN transaction_status = 'FAILED' THEN cents ELSE 0 END)")} AS worst_value
  FROM fact_transactions JOIN dim_customers USING (customer_id) WHERE city = 'Tier-2 Cities'
  GROUP BY gateway ORDER BY worst_value DESC, gateway LIMIT 1""",
    "digest_at_risk_total": f"""{reports.CHURN}, few AS (
  SELECT * FROM totals WHERE c >= 2500000 AND fn * 100 >= n * 20 ORDER BY c DESC, customer_id LIMIT 15)
SELECT count(*) AS customers, {money('sum(c)')} AS total_at_risk_spend_inr FROM few""",
    "digest_default": """, s AS (SELECT transaction_status, count(*) AS n FROM fact_transactions GROUP BY 1)
SELECT 'transaction_count' AS main_column, count(*) AS records, CAST(sum(n) AS DOUBLE) AS total_value,
  CAST(sum(n) AS DOUBLE) / count(*) AS avg_value FROM s""",
    "digest_macro": """SELECT total_gmv_inr, success_rate_pct, revenue_at_risk_inr, fraud_blocked_inr FROM (
  """ + reports.BODIES["macro_kpis_case"] + ") t",
    "run_sql": f"""SELECT payment_method_name, is_international, count(*) AS attempts, {BAD} AS failed_attempts,
  max(failed_txn_count_24h) AS most_failures_24h FROM fact_transactions JOIN dim_payment_methods
  USING (payment_method_id) GROUP BY payment_method_name, is_international""",
}

SQL = {name: star(body) for name, body in BODIES.items()}

SQL["report_catalog"] = "\nUNION ALL ".join(
    f"SELECT {i} AS report_id, '{name}' AS report_name, '{file}' AS file_name,"
    f" (SELECT count(*) FROM ({reports.SQL[key]}) q) AS exported_rows, 'EXPORTED' AS status"
    for i, name, file, key in SUITE
)
