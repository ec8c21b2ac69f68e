"""What the plans of the main reports must and must not hold."""

from tillscope.operators import profile, selection
from tillscope.plans import measures, reports
from tillscope.session import settle
from tillscope.sources.tables import read_star, write_star
from tillscope.star import Star


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_filters_and_columns_reach_the_scan(spark, star, tmp_path):
    stored = read_star(spark, write_star(star, str(tmp_path / "star")))
    text = plan(reports.top_merchants_by_loss(stored))
    assert "EqualTo(transaction_status,FAILED)" in text
    assert "ReadSchema: struct<merchant_id:bigint,transaction_status:string,amount_cents:bigint>" in text
    assert "TakeOrderedAndProject" in text


def test_small_tables_are_broadcast(star):
    for report in (reports.channel_performance, reports.gateway_sla, reports.failure_decomposition):
        text = plan(report(star))
        assert "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_fact_is_folded_before_it_meets_customers(star):
    text = plan(reports.segment_matrix(star))
    join = text.index("Join")
    assert "partial_count" in text[join:] or "partial_sum" in text[join:]


def test_no_merchant_rows_in_one_task(star):
    """Only the slice totals are gathered, never the merchants."""
    text = plan(reports.merchant_pareto(star))
    gathered = text[text.index("SinglePartition") :] if "SinglePartition" in text else ""
    assert "merchant_id" not in gathered


def test_python_stays_out_of_reports(star):
    for report in (reports.macro_kpis, reports.merchant_pareto, reports.churn_risk_tiers, reports.peak_hour_anomaly):
        assert "Python" not in plan(report(star))


def counted(spark, df):
    """The same rows, with a counter of all that is read of them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_profile_report_reads_the_feed_three_times(spark, raw):
    feed, seen = counted(spark, raw)
    assert profile.report(feed).count() > 100
    assert seen.value == 3 * raw.count()
    some = raw.unionByName(raw.limit(10))
    feed, seen = counted(spark, settle(some))
    assert profile.report(feed).where("metric = 'duplicate_rows'").first().value == "10"
    assert seen.value == 4 * (raw.count() + 10)


def test_numbers_read_the_feed_twice(spark, raw):
    feed, seen = counted(spark, raw)
    profile.numbers(feed).collect()
    assert seen.value == 2 * raw.count()


def test_no_scan_makes_a_line_of_every_value(raw):
    lines = selection.Lines(raw, ["transaction_amount", "customer_id"], texts=["device_type"])
    assert "Generate" not in plan(selection.folded(lines, selection.brackets(lines)))
    assert "Generate" not in plan(raw.agg(*selection.bracket_terms(lines)))


def test_totals_of_any_number_of_columns_read_the_fact_twice_at_most(spark, star):
    names = ["total_transactions", "failure_rate", "at_risk_customers", "top_20_merchant_loss_share", "successful_transactions"]
    n = star.fact.count()
    for by in (["gateway"], ["customer_segment", "payment_method_code", "gateway"], ["transaction_status", "gateway"]):
        fact, seen = counted(spark, star.fact)
        measured = Star(fact, star.customers, star.merchants, star.methods, star.reasons)
        measures.evaluate_with_totals(measured, names, by).collect()
        assert seen.value <= 2 * n, by
