from pyspark.sql import functions as F

from tillscope.operators import etl, quality
from tillscope.schemas import RAW_FEED, TABLES


def feed(spark, rows):
    base = dict.fromkeys(RAW_FEED.names)
    return spark.createDataFrame([tuple((base | r)[c] for c in RAW_FEED.names) for r in rows], RAW_FEED)


def test_star_keeps_the_contract(raw):
    star = etl.build_star(raw)
    for name, df in star.tables().items():
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in TABLES[name].schema]
    assert star.fact.count() == raw.count()
    audit = quality.not_null_audit(star).where("status = 'FAILED'")
    assert audit.count() == 0
    assert quality.fk_orphan_audit(star).first().foreign_key_integrity_status.startswith("PASSED")


def test_first_present_value_by_transaction(spark):
    rows = [
        {"transaction_id": 3, "customer_id": 1, "kyc_level": 3, "credit_score_band": 5},
        {"transaction_id": 1, "customer_id": 1, "kyc_level": None, "credit_score_band": 1},
        {"transaction_id": 2, "customer_id": 1, "kyc_level": 2, "credit_score_band": 2},
    ]
    got = etl.first_values(feed(spark, rows), "customer_id", ["kyc_level", "credit_score_band"]).first()
    assert (got.kyc_level, got.credit_score_band) == (2, 1)


def test_times(spark):
    df = feed(spark, [{"transaction_time": t} for t in ("2023-01-01 00:02:00.328105993", "junk", None, "2023-03-26 02:30:00")])
    got = [r[0] for r in df.select(etl.seconds_text("transaction_time")).collect()]
    assert got == ["2023-01-01 00:02:00", None, None, "2023-03-26 02:30:00"]


def test_times_do_not_depend_on_the_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = feed(spark, [{"transaction_time": "2023-03-26 02:30:00.9"}])
        assert df.select(etl.seconds_text("transaction_time")).first()[0] == "2023-03-26 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_small_steps(spark):
    df = spark.createDataFrame([("mOBILE phone", 0.1234)], "device string, score double")
    row = df.select(etl.capitalize("device"), etl.scale_risk("score"), etl.lookup(F.lit("Pune"), etl.CITY_STATE)).first()
    assert (row[0], float(row[1]), row[2]) == ("Mobile phone", 12.3, None)


def test_unknown_channel_has_no_method(spark):
    df = feed(spark, [{"transaction_id": 1, "payment_channel": "cheque"}, {"transaction_id": 2, "payment_channel": "upi"}])
    got = {r.transaction_id: r.payment_method_id for r in etl.channel_to_id(df, etl.payment_methods(spark)).collect()}
    assert got == {1: None, 2: 2}


def test_rules_in_order(spark):
    base = {"transaction_time": "2023-07-05 19:00:00", "payment_channel": "upi", "customer_id": 1}
    rows = [base | {"transaction_id": i, "is_fraud": int(i % 10 == 0)} for i in range(4000)]
    df = feed(spark, rows)
    residents = spark.createDataFrame([(1, "Tier-2 Cities")], "customer_id long, city string")
    marked = etl.mark_peak(df, residents)
    out = etl.label_status(marked)
    counts = {(r.transaction_status, r.failure_reason_id): r["count"] for r in out.groupBy("transaction_status", "failure_reason_id").count().collect()}
    assert counts["FRAUD_BLOCKED", 6] == 400
    assert set(counts) == {("FRAUD_BLOCKED", 6), ("FAILED", 4), ("SUCCESS", 0)}
    assert abs(counts["FAILED", 4] / 3600 - 0.35) < 0.03
    elsewhere = etl.label_status(etl.mark_peak(df, residents.withColumn("city", F.lit("Mumbai"))))
    failed = elsewhere.where("transaction_status = 'FAILED'").count()
    assert abs(failed / 3600 - 0.12) < 0.03


def test_draws_repeat(raw):
    once = etl.build_star(raw).fact
    again = etl.build_star(raw.repartition(5)).fact
    assert once.exceptAll(again).count() == 0


def test_city_drawn_on_the_row_is_the_customers(spark):
    rows = [
        {"transaction_id": i, "customer_id": i % 90 if i % 11 else None, "transaction_time": f"2023-0{6 + i % 2}-05 19:00:00", "payment_channel": "upi", "is_fraud": 0}
        for i in range(600)
    ]
    df = feed(spark, rows)
    drawn = etl.mark_peak(df).select("transaction_id", "is_peak")
    joined = etl.mark_peak(df, etl.build_customers(df)).select("transaction_id", "is_peak")
    assert drawn.count() == 600 and drawn.where("is_peak").count() > 0
    assert drawn.exceptAll(joined).count() == 0
