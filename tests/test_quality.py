import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_plans import plan
from tiny import customer, merchant, tiny_star, txn

from tillscope.operators import profile, quality, selection
from tillscope.schemas import TABLES
from tillscope.session import settle
from tillscope.sources import tables
from tillscope.star import Star


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_key_audit_finds_duplicates_and_nulls(spark):
    star = tiny_star(spark, [txn(1), txn(1), txn(1), txn(None), txn(2)])
    got = rows_of(quality.pk_audit(star), "table_name")["fact_transactions",]
    assert (got.null_keys, got.duplicate_keys, got.excess_rows, got.status) == (1, 1, 2, "FAILED")


def test_orphans(spark):
    star = tiny_star(spark, [txn(1), txn(2, customer=9), txn(3, customer=None, merchant=9)], [customer(1), customer(1)])
    row = quality.fk_orphan_audit(star).first()
    assert (row.total_fact_records, row.orphan_customers, row.orphan_merchants) == (3, 2, 1)
    assert row.orphan_payment_methods == row.orphan_failure_reasons == 0
    assert row.foreign_key_integrity_status == "FAILED (Orphans Detected)"
    assert {r.transaction_id for r in quality.fk_orphan_rows(star, "customer_id").collect()} == {2, 3}


def test_not_null_and_domains(spark):
    star = tiny_star(spark, [txn(1, transaction_status="S" * 51), txn(2, amount=None)], merchants=[merchant(1)])
    nulls = rows_of(quality.not_null_audit(star), "table_name", "column_name")
    assert nulls["fact_transactions", "amount"].bad_rows == 1
    domains = rows_of(quality.domain_audit(star), "table_name", "column_name")
    assert domains["fact_transactions", "transaction_status"].status == "FAILED"
    assert domains["dim_merchants", "merchant_name"].status == "PASSED"


def test_a_number_too_wide_fails_its_domain(spark):
    """A wide-typed source is audited before the typed load."""
    star = tiny_star(spark, [txn(1), txn(2)])
    wide = F.when(F.col("transaction_id") == 2, F.lit("12345678901.00")).otherwise(F.lit("1.00")).cast("decimal(20,2)")
    small = [star.table(n) for n in TABLES if n != "fact_transactions"]
    source = Star(star.fact.withColumn("amount", wide), *small)
    rows = rows_of(quality.domain_audit(source), "column_name", "check_name")
    assert (rows["amount", "NUMERIC(12,2)"].status, rows["amount", "NUMERIC(12,2)"].bad_rows) == ("FAILED", 1)
    assert rows["amount", "SCALE <= 2"].status == "PASSED"


def test_text_is_audited_before_the_cast(spark):
    """Overflows, texts that are no numbers, times or integers, places that would be rounded away, empty values."""
    texts = {n: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for n, df in tiny_star(spark, [txn(1)]).tables().items()}
    base = texts["fact_transactions"].first().asDict()
    odd = [("99999999999.99", "1.0", "2023-07-03 12:00:00", "1"), ("1.005", "1.25", "yesterday", "yes"), ("1.500", "", "2023-07-03", "1.5"), ("1e3", "1e2", None, None)]
    rows = [tuple((base | dict(zip(("amount", "risk_score", "transaction_timestamp", "is_fraud"), o)))[c] for c in TABLES["fact_transactions"].names) for o in odd]
    texts["fact_transactions"] = spark.createDataFrame(rows, texts["fact_transactions"].schema)
    bad = {k: r.bad_rows for k, r in rows_of(quality.domain_audit(texts), "column_name", "check_name").items()}
    assert (bad["amount", "NUMERIC(12,2)"], bad["amount", "SCALE <= 2"]) == (1, 1)
    assert (bad["risk_score", "NUMERIC(5,1)"], bad["risk_score", "SCALE <= 1"]) == (0, 1)
    assert bad["transaction_timestamp", "TIMESTAMP_NTZ"] == 1 and bad["is_fraud", "INT"] == 2


def test_reconcile_reports_a_mismatch(spark):
    a = spark.createDataFrame([("t", 5), ("u", 3)], "table_name string, source_rows long")
    b = spark.createDataFrame([("t", 5), ("v", 1)], "table_name string, loaded_rows long")
    got = rows_of(quality.reconcile(a, b), "table_name")
    assert got["t",].status == "MATCH (OK)" and got["u",].status == got["v",].status == "MISMATCH"
    assert {r.overall_status for r in got.values()} == {"FAILED"}


def test_rejects_are_kept_apart(spark, tmp_path):
    path = tmp_path / "m"
    path.mkdir()
    header = ",".join(TABLES["dim_merchants"].names)
    (path / "a.csv").write_text(f"{header}\n1,Merchant_1,Gaming,Mumbai,Maharashtra,0.1\nx,y\n")
    good, bad = tables.scan_csv_rejects(spark, str(path), TABLES["dim_merchants"])
    assert [r.merchant_id for r in good.collect()] == [1]
    assert [r[tables.REJECT] for r in bad.collect()] == ["x,y"]


def test_bucketed_layout_holds_the_same_rows(spark, star, tmp_path):
    tables.write_layout(star.fact, str(tmp_path / "b"), bucket_table="bucketed_fact")
    stored = spark.table("bucketed_fact").select(*star.fact.columns)
    assert stored.exceptAll(star.fact).count() == 0 and stored.count() == 6000


def test_duplicates_compare_whole_rows(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (2, 2), (2, 2), (2, 2)], "a int, b int")
    row = profile.duplicates(df).first()
    assert (row.total_rows, row.duplicate_rows, row.duplicate_pct) == (6, 3, Decimal("50.00"))
    assert profile.duplicates(df.limit(0)).first().duplicate_rows == 0


def test_medians(spark):
    df = spark.createDataFrame(
        [(1.0, 4, None), (2.0, 4, 1.0), (10.0, 1, None), (11.0, 9, 3.0)], "x double, y int, z double"
    )
    got = {r.column_name: r.median_value for r in profile.medians(df, ["x", "y", "z"]).collect()}
    assert got == {"x": 6.0, "y": 4.0, "z": 2.0}


def test_medians_match_builtin(raw):
    names = ["transaction_amount", "merchant_risk_score", "customer_id"]
    want = raw.agg(*[F.median(c).alias(c) for c in names]).first()
    got = {r.column_name: r.median_value for r in profile.medians(raw, names).collect()}
    assert got == {c: float(want[c]) for c in names}


def exact(df, **options):
    names = [c for c in df.columns]
    return {r.column_name: r for r in selection.described(df, names, **options).collect()}


def test_long_ids_keep_their_digits(spark):
    """Nineteen digits, decimals of thirty, and two ids that are one double."""
    rows = [(1234567890123456789, Decimal("123456789012345678901234567890.12")), (1234567890123456791, Decimal("-0.07")), (None, None)]
    got = exact(spark.createDataFrame(rows, "id bigint, amount decimal(38,2)"))
    assert (got["id"].min_exact, got["id"].max_exact) == ("1234567890123456789.0000", "1234567890123456791.0000")
    assert got["id"].median_exact == "1234567890123456790.0000"
    assert (got["amount"].min_exact, got["amount"].max_exact) == ("-0.0700", "123456789012345678901234567890.1200")
    assert got["amount"].median_exact == "61728394506172839450617283945.0250"


def test_medians_by_bracket_match_sorted_values(spark):
    """Skewed, few and many distinct values, infinities and NaN, empty columns, even and odd counts, coarse sketches."""
    rng = random.Random(4)
    for n in (1, 2, 5, 4000, 4001):
        rows = [
            (rng.choice([0, 0, 0, 7, None]), rng.randrange(-(10**18), 10**18), rng.gauss(0, 1e9), rng.choice([1.5, float("nan"), None]), None,
             Decimal(rng.randrange(10**6)) / 100, rng.choice([float("-inf"), 2.0, float("inf")]), i)
            for i in range(n)
        ]
        df = spark.createDataFrame(rows, "few int, wide bigint, real double, holes double, none int, money decimal(12,2), ends double, each smallint").repartition(4)
        for accuracy in (20, 2000):
            got = exact(df, accuracy=accuracy)
            for k, name in enumerate(df.columns):
                values = sorted(v for v in (r[k] for r in rows) if v is not None and v == v)
                row = got[name]
                if not values:
                    assert row.min_value is None and row.median_exact is None
                    continue
                low, high = values[(len(values) - 1) // 2], values[len(values) // 2]
                assert (row.min_value, row.max_value) == (float(values[0]), float(values[-1]))
                assert row.median_value == pytest.approx(float(low) if low == high else (float(low) + float(high)) / 2, rel=1e-15, nan_ok=True)
                if name != "ends":
                    assert row.mean_value == pytest.approx(float(sum(map(Fraction, values)) / len(values)), rel=1e-12, abs=1e-6)


def test_a_bracket_that_misses_is_widened(spark):
    df = spark.createDataFrame([(i,) for i in range(1001)], "n int")
    lines = selection.Lines(df, ["n"])
    found = selection.brackets(lines)
    wrong = {0: Row(place=0, min_k=0, max_k=1000, min_x=None, max_x=None, around=[3.0, 4.0, 5.0])}
    right = selection.middles(lines, found)[0]
    again = selection.middles(lines, wrong)[0]
    assert (again.low_k, again.high_k, again.rows, again.total) == (right.low_k, right.high_k, right.rows, right.total) == (500, 500, 1001, 500500)


def test_only_the_bracket_is_shuffled(spark):
    """A column of ten thousand different values folds to the few in the middle and one row a task for each side."""
    df = spark.range(10_000).repartition(4)
    lines = selection.Lines(df, ["id"])
    assert selection.folded(lines, selection.brackets(lines)).count() < 100


def test_means_do_not_depend_on_the_order(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1e16, -1e16, 1.0, 0.1, 3e-7]) * rng.random(),) for _ in range(5000)]
    means = {exact(spark.createDataFrame(rng.sample(rows, len(rows)), "x double").repartition(k))["x"].mean_value for k in (1, 3, 8)}
    assert len(means) == 1


def test_duplicates_with_colliding_hashes(spark):
    """Rows whose hashes all meet are told apart by their columns."""
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (2, None), (None, "b")], "n int, t string")
    same = {"_h1": F.lit(1).cast("bigint"), "_h2": F.lit(2).cast("bigint")}
    for limit in (0, 100):
        row = profile.duplicates(df, hashes=same, limit=limit).first()
        assert (row.total_rows, row.duplicate_rows) == (6, 2)
        assert profile.duplicates(df, limit=limit).first().duplicate_rows == 2


def test_duplicates_by_one_hash_a_row(spark, raw):
    """A second hash would double the shuffle; whole rows are compared wherever hashes meet, here in all rows."""
    assert len(profile.row_hashes(raw)) == 1
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (2, None), (None, "b")], "n int, t string")
    for limit in (0, 100):
        assert profile.duplicates(df, hashes={"_h1": F.lit(1).cast("bigint")}, limit=limit).first().duplicate_rows == 2


def test_sums_of_batches_are_exact(spark):
    """Sums beyond a bigint, of both signs, below, inside and above the bracket."""
    values = [2**63 - 1] * 700 + [-(2**63)] * 500 + [-1, 0, 1, 2**32 - 1, -(2**32)] * 9
    lines = selection.Lines(spark.createDataFrame([(v,) for v in values], "n bigint").repartition(3), ["n"])
    row = selection.middles(lines, selection.brackets(lines))[0]
    assert (row.rows, int(row.total)) == (len(values), sum(values))


def test_duplicates_of_signed_zeros_nans_and_nulls(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (nan, 1.0), (nan, 1.0), (None, nan), (1.0, nan)], "a double, b double")
    assert profile.duplicates(df).first().duplicate_rows == df.count() - df.distinct().count() == 2


def test_duplicates_shuffle_no_column_of_a_row_without_a_twin(spark, raw):
    text = plan(profile.duplicates(settle(raw.union(raw.limit(10)))))
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_h1" not in line]
    filtered = text.index("LeftSemi") if "LeftSemi" in text else -1
    assert "BroadcastHashJoin" in text and filtered > 0 and all(text.index(s) < filtered for s in shuffles)


def test_roles_and_times(spark):
    df = spark.createDataFrame([("2023-01-01 00:00:00.5", "x", 1), ("bad", "y", 2), (None, "y", 3)], "event_time string, kind string, n int")
    assert profile.column_roles(df) == {"event_time": "date", "kind": "text", "n": "numeric"}
    row = profile.timestamps(df).first()
    assert (row.valid_count, row.failed_count, row.range_days) == (1, 1, 0.0)
    assert profile.timestamps(df.select("n")) is None


def test_categories_count_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "kind string")
    rows = profile.categories(df, top_k=2).orderBy("value_rank").collect()
    assert [(r.value, r.value_count, r.cardinality) for r in rows] == [("a", 2, 3), (None, 1, 3)]


def test_approximate_profile(raw):
    rows = {r.column_name: r for r in profile.numbers(raw, approx=True).collect()}
    assert abs(rows["kyc_level"].median_value - 2) <= 1
